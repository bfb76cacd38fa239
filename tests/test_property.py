import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import property as ops
from ledgerline.schemas import SALE_COLUMNS, text_schema


def sale(price, date="2010-01-25 00:00", kind="D", district="D1", county="KENT"):
    row = dict.fromkeys(SALE_COLUMNS, "x")
    row.update(price=price, date_of_transfer=date, property_type=kind, district=district, county=county)
    return tuple(row[name] for name in SALE_COLUMNS)


def clean(spark, *sales):
    return ops.clean_sales(spark.createDataFrame(list(sales), text_schema(SALE_COLUMNS)))


@pytest.mark.parametrize("bad", [sale("NOT_A_NUM"), sale("12.7"), sale(None), sale("1", "INVALID_DATE"), sale("1", None)])
def test_bad_price_or_date_is_dropped(spark, bad):
    kept = clean(spark, sale("250000"), bad).collect()
    assert [(r["price"], r["year"]) for r in kept] == [(250000, 2010)]


def test_all_bad(spark):
    assert clean(spark, sale("NOT_A_PRICE"), sale("ALSO_BAD")).count() == 0


def report_sales(spark):
    return clean(
        spark,
        *[sale(str(3000 * k), "1999-11-30 00:00", "F", "NORTHAM", "EASTSHIRE") for k in range(1, 201)],
    )


REPORT = {
    "affordability_gap": [("NORTHAM", "EASTSHIRE", 300000, 540000, 60000, 200, 9.0)],
    "by_county": [("EASTSHIRE", 200, 301500.0, 300000, 600000, 3000)],
    "by_year": [(1999, 200, 300000, 301500.0)],
    "by_property_type": [("F", 200, 300000, 301500.0)],
}


@pytest.mark.parametrize("exact", [False, True])
def test_single_tables(spark, exact):
    sales = report_sales(spark)
    for name, wanted in REPORT.items():
        assert [tuple(r) for r in getattr(ops, name)(sales, exact=exact).collect()] == wanted


def test_report(spark):
    report = ops.property_report(ops.report_stats(report_sales(spark)))
    assert {name: [tuple(r) for r in df.collect()] for name, df in report.items()} == REPORT


def test_report_equals_the_single_tables(spark):
    rng = random.Random(4)
    data = [
        (rng.randint(1, 10**6), rng.choice([2010, 2011]), rng.choice(["D", "S", None]), rng.choice(["a", "b", None]), rng.choice(["K", None]))
        for _ in range(900)
    ]
    sales = spark.createDataFrame(data, "price bigint, year int, property_type string, district string, county string")
    for name, df in ops.property_report(ops.report_stats(sales)).items():
        assert df.collect() == getattr(ops, name)(sales).collect()


def test_years_ascend(spark):
    sales = clean(spark, sale("200000", "2015-01-01 00:00"), sale("300000"), sale("250000", "2020-05-05 00:00"))
    assert [r["year"] for r in ops.by_year(sales).collect()] == [2010, 2015, 2020]
    trend = [tuple(r) for r in ops.yoy_trend(sales).collect()]
    assert trend[0] == (2010, 300000, None, None)
    assert trend[1][2:] == (300000, pytest.approx(-33.3333333))


def test_counties_by_median(spark):
    sales = clean(spark, sale("100000", county="SURREY"), sale("500000", county="LONDON"), sale("250000", county="KENT"))
    assert [r["county"] for r in ops.by_county(sales).collect()] == ["LONDON", "KENT", "SURREY"]


def test_threshold_is_strict_and_zero_price_gives_no_ratio(spark):
    def many(n, name, price="500"):
        return [sale(price, district=name)] * n

    sales = clean(spark, *many(50, "a"), *many(101, "b"), *many(100, "c"), *many(120, "z", "0"))
    found = {r["district"]: r["affordability_ratio"] for r in ops.affordability_gap(sales).collect()}
    assert found == {"b": 1.0, "z": None}


def test_exact_percentiles_equal_percentile_disc(spark):
    rng = random.Random(11)
    data = [
        (rng.choice(["hot"] * 6 + ["cold", None]), rng.choice([None, -5, 0, 9999, 10000, rng.randint(-30000, 900000)]))
        for _ in range(5000)
    ] + [("unpriced", None)] * 3
    df = spark.createDataFrame(data, "county string, price bigint")
    found = {tuple(r) for r in ops.exact_stats(df, ["county"], (100, 333, 500, 900, 1000)).collect()}
    wanted = df.groupBy("county").agg(
        F.count(F.lit(1)), F.avg("price"), F.max("price"), F.min("price"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY price)") for p in (0.1, 0.333, 0.5, 0.9, 1.0)]
    )
    assert found == {tuple(r) for r in wanted.collect()}


def random_sales(spark, seed, n):
    rows = spark.range(n, numPartitions=3).select(
        F.floor(F.exp(F.randn(seed) + 12)).cast("bigint").alias("price"), (1990 + F.col("id") % 3).cast("int").alias("year"),
        F.lit("D").alias("property_type"), F.concat(F.lit("d"), F.col("id") % 2).alias("district"), F.lit("KENT").alias("county"),
    )
    return spark.createDataFrame(rows.toPandas())


def test_kept_report_equals_one_pass_up_to_the_rank_error(spark, tmp_path):
    deliveries = [random_sales(spark, seed, n) for seed, n in ((1, 30_000), (2, 10), (3, 12_000))]
    for k, sales in enumerate([*deliveries, deliveries[1]]):  # one comes again
        ops.keep_report(sales, str(tmp_path), f"b{k % 3 if k < 3 else 1}", 1024)
    whole = deliveries[0].unionAll(deliveries[1]).unionAll(deliveries[2])
    keys = ["result", *ops.REPORT_KEYS]
    found = {tuple(r[k] for k in keys): r for r in ops.kept_report(spark, str(tmp_path)).collect()}
    exact = {tuple(r[k] for k in keys): r for r in ops.report_stats(whole).collect()}
    assert set(found) == set(exact)
    prices = whole.toPandas()
    for key, row in found.items():
        own = prices
        for name, value in zip(ops.REPORT_KEYS, key[1:]):
            own = own[own[name] == value] if value is not None else own
        assert (row["total_sales"], row["max_price"], row["min_price"]) == tuple(exact[key][n] for n in ("total_sales", "max_price", "min_price"))
        assert row["avg_price"] == pytest.approx(exact[key]["avg_price"])
        for p in ops.GAP_PER_MILLE:
            low, high = (own["price"] < row[f"p{p}"]).mean(), (own["price"] <= row[f"p{p}"]).mean()
            assert low - 0.01 <= p / 1000 <= high + 0.01


def test_small_groups_have_exact_percentiles_however_they_are_cut(spark, tmp_path):
    sales = report_sales(spark).select("price", "year", "property_type", "district", "county")
    for k in range(4):
        ops.keep_report(sales.filter(F.col("price") % 4 == k), str(tmp_path), f"b{k}")
    ops.keep_report(sales.limit(0), str(tmp_path), "empty")
    tables = ops.property_report(ops.kept_report(spark, str(tmp_path)))
    assert {name: [tuple(r) for r in df.collect()] for name, df in tables.items()} == {**REPORT, "by_property_type": [("F", 200, 300000, 301500.0)]}

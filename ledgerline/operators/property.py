"""House-price jobs over cleaned sales."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.frames import match_nulls_join
from ledgerline.functions.scalars import rounded_ratio, sale_year, to_long

PRICE_STEP = 10_000
MIN_SALES = 100
GAP_PER_MILLE = (100, 500, 900)
SKETCH_SIZE = 1024
PART_FIGURES = ["total_sales", "paid", "priced", "max_price", "min_price", "sketch"]


def clean_sales(raw: DataFrame) -> DataFrame:
    """Typed price and year; a sale without either is dropped."""
    return (
        raw.withColumn("price", to_long(F.col("price")))
        .withColumn("year", sale_year(F.col("date_of_transfer")))
        .filter(F.col("price").isNotNull() & F.col("year").isNotNull())
    )


def exact_stats(sales: DataFrame, keys, per_mille) -> DataFrame:
    """keys, total_sales, avg_price, max_price, min_price and exact discrete percentiles p<n>, in one scan.

    Prices are counted first, with map-side combining, and everything else follows from the counts. They are summed
    in steps of ``PRICE_STEP``, a window over the steps finds those that hold a wanted position, and only
    their prices are walked. A window task holds the steps of a group, at most its price range divided by
    PRICE_STEP, or the prices of a step, at most PRICE_STEP, however many sales there are.
    """
    counts = sales.groupBy(*keys, F.floor(F.col("price") / PRICE_STEP).alias("step"), "price").agg(
        F.count(F.lit(1)).alias("n")
    )
    priced = F.when(F.col("price").isNotNull(), F.col("n")).otherwise(0)
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    steps = (
        counts.groupBy(*keys, "step")
        .agg(
            F.sum("n").alias("sales"),
            F.sum(priced).alias("n"),
            F.sum(F.col("price").cast("double") * F.col("n")).alias("paid"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
        )
        .select(
            *keys,
            "step",
            "n",
            upto.alias("upto"),
            F.sum("n").over(group).alias("total"),
            F.sum("sales").over(group).alias("total_sales"),
            F.sum("paid").over(group).alias("paid"),
            F.max("high").over(group).alias("max_price"),
            F.min("low").over(group).alias("min_price"),
        )
    )
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"(total * {p} + 999) div 1000").alias("position")) for p in per_mille])

    def between(position, low, high):
        return (position > low) & (position <= high)

    targets = steps.select(
        *keys,
        "step",
        (F.col("upto") - F.col("n")).alias("before"),
        (F.col("paid") / F.nullif("total", F.lit(0))).alias("avg_price"),
        "total",
        "total_sales",
        "max_price",
        "min_price",
        F.filter(wanted, lambda t: between(t["position"], F.col("upto") - F.col("n"), F.col("upto"))).alias("targets"),
    ).filter((F.size("targets") > 0) | (F.col("total") == 0))
    in_step = Window.partitionBy(*keys, "step").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    stats = ["total_sales", "avg_price", "max_price", "min_price"]
    walked = (
        match_nulls_join(counts, targets, [*keys, "step"])
        .withColumn("reached", F.col("before") + F.sum("n").over(in_step))
        .select(*keys, *stats, "price", "n", "reached", F.inline_outer("targets"))
        .filter(F.col("p").isNull() | between(F.col("position"), F.col("reached") - F.col("n"), F.col("reached")))
    )
    return walked.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in stats],
        *[F.max(F.when(F.col("p") == p, F.col("price"))).alias(f"p{p}") for p in per_mille],
    )


def _plain_stats():
    return [
        F.count(F.lit(1)).alias("total_sales"),
        F.avg("price").alias("avg_price"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
    ]


def _sketched(per_mille):
    """One mergeable sketch for all percentiles."""
    return F.percentile_approx("price", F.array(*[F.lit(p / 1000) for p in per_mille])).alias("points")


def price_stats(sales: DataFrame, keys, exact=False, per_mille=(500,)) -> DataFrame:
    """keys, total_sales, avg_price, max_price, min_price and one p<n> column per percentile.

    Percentiles come from the approximate sketch; ``exact`` walks counted prices instead.
    """
    if exact:
        return exact_stats(sales, keys, per_mille)
    points = [F.col("points")[i].alias(f"p{p}") for i, p in enumerate(per_mille)]
    stats = sales.groupBy(*keys).agg(*_plain_stats(), _sketched(per_mille))
    return stats.select(*keys, "total_sales", "avg_price", "max_price", "min_price", *points)


def _county_table(stats):
    return stats.select(
        "county", "total_sales", "avg_price", F.col("p500").alias("median_price"), "max_price", "min_price"
    ).orderBy(F.desc("median_price"), "county")


def _year_table(stats):
    return stats.select("year", "total_sales", F.col("p500").alias("median_price"), "avg_price").orderBy("year")


def _type_table(stats):
    return stats.select(
        "property_type", F.col("total_sales").alias("count"), F.col("p500").alias("median_price"), "avg_price"
    ).orderBy(F.desc("count"), "property_type")


def _gap_table(stats, min_sales):
    return (
        stats.filter(F.col("total_sales") > min_sales)
        .select(
            "district",
            "county",
            F.col("p500").alias("median_price"),
            F.col("p900").alias("p90_price"),
            F.col("p100").alias("p10_price"),
            "total_sales",
            rounded_ratio(F.col("p900"), F.col("p100")).alias("affordability_ratio"),
        )
        .orderBy(F.desc("affordability_ratio"), "district", "county")
    )


def by_county(sales: DataFrame, exact=False) -> DataFrame:
    return _county_table(price_stats(sales, ["county"], exact))


def by_year(sales: DataFrame, exact=False) -> DataFrame:
    return _year_table(price_stats(sales, ["year"], exact))


def by_property_type(sales: DataFrame, exact=False) -> DataFrame:
    return _type_table(price_stats(sales, ["property_type"], exact))


def affordability_gap(sales: DataFrame, min_sales=MIN_SALES, exact=False) -> DataFrame:
    """Ratio of the dear to the cheap end per district, for districts above ``min_sales`` sales."""
    return _gap_table(price_stats(sales, ["district", "county"], exact, GAP_PER_MILLE), min_sales)


REPORT_KEYS = ["county", "year", "property_type", "district"]


def _of_all_tables(sales: DataFrame, figures) -> DataFrame:
    """result, keys and ``figures`` of the groups of all four price tables, from one pass over the sales."""
    grouped = sales.groupingSets(
        [["county"], ["year"], ["property_type"], ["district", "county"]], *[F.col(key) for key in REPORT_KEYS]
    )
    stats = grouped.agg(*figures, *[F.grouping(key).alias(f"{key}_rolled") for key in REPORT_KEYS])
    result = (
        F.when(F.col("year_rolled") == 0, "by_year")
        .when(F.col("property_type_rolled") == 0, "by_property_type")
        .when(F.col("district_rolled") == 0, "affordability_gap")
        .otherwise("by_county")
    )
    return stats.withColumn("result", result).drop(*[f"{key}_rolled" for key in REPORT_KEYS])


def report_stats(sales: DataFrame) -> DataFrame:
    """The groups of all four price tables from one pass over the sales, told apart by ``result``.

    The sales are read once and only partial statistics are shuffled; the outcome has one row
    per group and is small enough to persist for the four writes.
    """
    stats = _of_all_tables(sales, [*_plain_stats(), _sketched(GAP_PER_MILLE)])
    points = [F.col("points")[i].alias(f"p{p}") for i, p in enumerate(GAP_PER_MILLE)]
    return stats.select("result", *REPORT_KEYS, "total_sales", "avg_price", "max_price", "min_price", *points)


def report_parts(sales: DataFrame, sketch_size=SKETCH_SIZE) -> DataFrame:
    """``report_stats`` of some of the sales in figures that add up: counts, sums, extremes and quantile sketches."""
    figures = [
        F.count(F.lit(1)).alias("total_sales"), F.sum("price").alias("paid"), F.count("price").alias("priced"),
        F.max("price").alias("max_price"), F.min("price").alias("min_price"),
        F.kll_sketch_agg_bigint("price", sketch_size).alias("sketch"),
    ]
    return _of_all_tables(sales, figures).select("result", *REPORT_KEYS, *PART_FIGURES)


def merged_report(parts: DataFrame) -> DataFrame:
    """``report_stats`` of all sales that went into ``parts``, in whatever pieces and order.

    Percentiles are those of the merged sketches: exact up to ``sketch_size`` sales of a group, beyond that off by a
    share of the ranks that shrinks with it (about 0.3 % at 1024, 0.1 % at 4096).
    """
    merged = parts.groupBy("result", *REPORT_KEYS).agg(
        F.sum("total_sales").alias("total_sales"),
        F.try_divide(F.sum("paid").cast("double"), F.sum("priced")).alias("avg_price"),
        F.max("max_price").alias("max_price"),
        F.min("min_price").alias("min_price"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )
    known = F.kll_sketch_get_n_bigint("sketch") > 0
    points = [
        F.when(known, F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 1000))).alias(f"p{p}") for p in GAP_PER_MILLE
    ]
    return merged.select("result", *REPORT_KEYS, "total_sales", "avg_price", "max_price", "min_price", *points)


def keep_report(sales: DataFrame, folder: str, batch: str, sketch_size=SKETCH_SIZE) -> None:
    """Add the sales of one delivery to the report kept in ``folder``; a ``batch`` that is added again replaces itself."""
    report_parts(sales, sketch_size).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def kept_report(spark: SparkSession, folder: str) -> DataFrame:
    """``report_stats`` of all deliveries in ``folder``, from their parts alone."""
    return merged_report(spark.read.parquet(folder).drop("batch"))


def property_report(stats: DataFrame, min_sales=MIN_SALES) -> dict:
    """The four price tables from ``report_stats``."""

    def part(name):
        return stats.filter(F.col("result") == name)

    return {
        "by_county": _county_table(part("by_county")),
        "by_year": _year_table(part("by_year")),
        "by_property_type": _type_table(part("by_property_type")),
        "affordability_gap": _gap_table(part("affordability_gap"), min_sales),
    }


def county_contract(sales: DataFrame) -> DataFrame:
    return sales.groupBy("county").agg(
        F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("transaction_count")
    )


def yoy_trend(sales: DataFrame, exact=False) -> DataFrame:
    """Median by year with its change; the window runs over one row per year."""
    years = by_year(sales, exact)
    order = Window.partitionBy(F.lit(1)).orderBy("year")
    previous = F.lag("median_price").over(order)
    return years.select(
        "year",
        "median_price",
        previous.alias("previous_median"),
        F.try_divide((F.col("median_price") - previous) * 100.0, previous).alias("change_pct"),
    )

import pytest

from pyspark.sql import functions as F

from ledgerline.functions.scalars import count_or_zero
from ledgerline.operators import usage as ops


def dump(spark, *lines):
    df = spark.createDataFrame([("s", line) for line in lines], "scrape string, line string")
    return ops.usage_dump(df, ["scrape"]).collect()[0]


@pytest.mark.parametrize(
    "line, cpu, memory",
    [
        ("a 250m 512Mi", 250, 512),
        ("b 2 1Gi", 2000, 1024),
        ("c 10m 1024Ki", 10, 1),
        ("d 1m 1048576", 1, 1),
        ("  e\t1500m \t 2Ti ", 1500, 2097152),
        ("f 0.5 1.9Mi", 500, 1),
        ("g 1m 1048576K", 1, 1000),
        ("h 1m 1M", 1, 0),
        ("i 1m 2G", 1, 1907),
    ],
)
def test_units(spark, line, cpu, memory):
    row = dump(spark, line)
    assert (row["cpu_millicores"], row["memory_mib"]) == (cpu, memory)


def test_short_lines_are_skipped(spark):
    assert tuple(dump(spark, "e", "f 5m", "g 1m 3Mi", ""))[1:] == (4, 6, 3, 2, 3)


def test_unreadable_number_spoils_the_total(spark):
    row = dump(spark, "a 250m 512Mi", "b <unknown> 1Mi", "c 1m 7Xi")
    assert (row["cpu_millicores"], row["memory_mib"]) == (None, None)


@pytest.mark.parametrize(
    "answer, total",
    [
        ('{"data":{"result":[{"value":[0,"1.9"]},{"value":[0,"2.3"]}]}}', 4),
        ('{"status":"success","data":{"resultType":"vector","result":[{"metric":{"pod":"a"},"value":[1.5,"7"]}]}}', 7),
        ('{"data":{"result":[]}}', None),
        ('{"data":{}}', None),
        ("{}", None),
        ("not json", None),
        (None, None),
        ('{"data":{"result":[{"value":[0,"x"]},{"value":[0,"2"]}]}}', None),
        ('{"data":{"result":[{"value":[0,"NaN"]}]}}', None),
        ('{"data":{"result":[{"value":[0,"-1.9"]}]}}', -1),
    ],
)
def test_answers(spark, answer, total):
    df = spark.createDataFrame([(1, answer)], "id int, answer string")
    assert [tuple(r) for r in ops.metric_answers(df).collect()] == [(1, total)]


def test_fallback_is_for_both_or_none(spark):
    schema = "t int, cpu_millicores bigint, memory_mib bigint"
    primary = spark.createDataFrame([(1, 10, 20), (2, None, 20), (3, 10, None), (4, None, None)], schema)
    other = spark.createDataFrame([(1, 1, 1), (2, 5, 6), (3, 7, 8), (5, 9, 10), (6, None, 4)], schema)
    found = {tuple(r) for r in ops.sample_fallback(primary, other, ["t"]).collect()}
    assert found == {(1, 10, 20, "metrics"), (2, 5, 6, "usage dump"), (3, 7, 8, "usage dump"), (4, 0, 0, "usage dump"), (5, 9, 10, "usage dump"), (6, 0, 4, "usage dump")}


def test_non_counts_become_zero(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("-3",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(count_or_zero(F.col("v"))).collect()] == [12, 0, 0, 0, 0, 0]

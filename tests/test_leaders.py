"""The k most frequent values against a plain count."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import leaders


def plain(values, k):
    return sorted(Counter(values).items(), key=lambda item: (-item[1], item[0] is not None, item[0]))[:k]


def found(spark, values, k, **sizes):
    df = spark.createDataFrame([(v,) for v in values], "who string")
    return [tuple(r) for r in leaders.most_frequent(df, "who", k, **sizes).collect()]


def skewed(seed, n=6000):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else f"u{min(int(rng.paretovariate(0.7)), 900)}" for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"parts": 3, "buckets": 16}, {"parts": 1, "buckets": 1}])
@pytest.mark.parametrize("values", [skewed(1), [f"u{i % 700}" for i in range(2100)], ["a"] * 40], ids=["skewed", "even", "one value"])
def test_equals_a_plain_count(spark, values, sizes):
    assert found(spark, values, 25, **sizes) == plain(values, 25)


def test_candidates_that_miss_do_not_matter(spark, monkeypatch):
    def poor(values, k, parts):
        return values.where(F.col("value").isin("u1", "u700")).distinct()

    monkeypatch.setattr(leaders, "likely_leaders", poor)
    values = skewed(2)
    assert found(spark, values, 25) == plain(values, 25)
    assert found(spark, values, 1) == plain(values, 1)


def test_ties_at_the_end_are_cut_by_value(spark):
    values = [f"u{i:02}" for i in range(50) for _ in range(3)] + ["z"] * 4
    assert found(spark, values, 3) == [("z", 4), ("u00", 3), ("u01", 3)]


def test_empty_and_fewer_values_than_asked(spark):
    assert found(spark, [], 5) == []
    assert found(spark, ["a", "b", "b", None], 5) == [("b", 2), (None, 1), ("a", 1)]


def test_no_bucket_is_doubtful_on_skewed_data(spark):
    values = [f"big{i}" for i in range(10) for _ in range(500)] + [f"u{i}" for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    bucket = F.pmod(F.xxhash64("value"), F.lit(4096)).alias("bucket")
    counts = leaders.bucket_counts(df.select("value", F.col("value").startswith("big").alias("candidate"), bucket))
    assert counts.count() < 4096
    assert leaders.doubtful_buckets(counts, 10).count() == 0
    assert leaders.doubtful_buckets(counts, 11).count() == counts.count() - 10


def test_values_are_numbers_too(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("n"))
    assert [tuple(r) for r in leaders.most_frequent(df, "n", 2, "seen").collect()] == [(0, 429), (1, 429)]

"""The most frequent values of a column, exactly, without counting every value."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.shared import written

PARTS = 64
BUCKETS = 1 << 20


def likely_leaders(values: DataFrame, k: int, parts=PARTS) -> DataFrame:
    """Up to k of ``value`` from each of ``parts`` sketches of frequent values, at most k * parts in all.

    Values are dealt to the parts by a hash, so the sketches of all tasks are merged in ``parts`` places, not in one.
    """
    sketch = F.expr(f"approx_top_k(value, {k}, {max(1000, 4 * k)})")
    part = F.pmod(F.xxhash64("value"), F.lit(parts))
    return values.groupBy(part.alias("part")).agg(sketch.alias("frequent")).select(F.explode("frequent.item").alias("value"))


def bucket_counts(marked: DataFrame) -> DataFrame:
    """Rows n of each candidate, and of each bucket of all other values."""
    value = F.when(F.col("candidate"), F.col("value"))
    bucket = F.when(~F.col("candidate"), F.col("bucket"))
    return marked.groupBy("candidate", value.alias("value"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def doubtful_buckets(counts: DataFrame, k: int) -> DataFrame:
    """Buckets with as many rows as the k-th best candidate, or all buckets if there are fewer than k candidates.

    A value has at most as many rows as its bucket, so no value of any other bucket is among the k best.
    """
    best = counts.where("candidate").orderBy(F.desc("n")).limit(k)
    bound = best.agg(F.when(F.count(F.lit(1)) >= k, F.min("n")).otherwise(0)).scalar()
    return counts.where(~F.col("candidate") & (F.col("n") >= bound)).select("bucket")


def most_frequent(rows: DataFrame, key: str, k: int, count_name="count", parts=PARTS, buckets=BUCKETS) -> DataFrame:
    """The k most frequent values of ``key`` with their exact counts, best first, ties by value; null is a value.

    Sketches propose candidates. One pass counts these exactly and all other rows by hash bucket, which is what
    is shuffled: at most ``buckets`` rows a task, however many values there are. The values of the buckets that could still
    hold one of the k best are then counted exactly. On skewed data there are few or none of these buckets; on even data they
    are all of them, and the work is that of a plain count. The result is exact either way, whatever the sketches miss.
    The column is read up to three times.
    """
    values = rows.select(F.col(key).alias("value"))
    leaders = written(likely_leaders(values, k, parts), "leaders").select(F.col("value").alias("leader"), F.lit(True).alias("found"))
    marked = values.join(leaders, F.col("value").eqNullSafe(F.col("leader")), "left").select(
        "value", F.col("found").isNotNull().alias("candidate"), F.pmod(F.xxhash64("value"), F.lit(buckets)).alias("bucket")
    )
    counts = written(bucket_counts(marked), "bucket-counts")
    others = marked.where("NOT candidate").join(doubtful_buckets(counts, k), "bucket", "left_semi")
    counted = others.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.where("candidate").select("value", "n").unionByName(counted).orderBy(F.desc("n"), "value").limit(k)
    return best.select(F.col("value").alias(key), F.col("n").alias(count_name))

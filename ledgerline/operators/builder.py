"""Resource samples built from what a cluster reports: pod metrics and usage dumps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import count_or_zero
from ledgerline.operators import series, usage
from ledgerline.operators.samples import INTERVAL_SECONDS, started_samples
from ledgerline.sources.shared import written


def metrics_to_samples(metrics: DataFrame, dump: DataFrame, run_id: str, interval_seconds=INTERVAL_SECONDS) -> DataFrame:
    """Samples of a run from pod metrics and usage dumps (strategy, timestamp, cpu_millicores, memory_mib).

    At every ``interval_seconds`` and strategy: the live pods, and CPU and memory from the metrics where both are
    known, else both from the dump. Whatever is not a plain count becomes 0, and a strategy's samples begin
    with its first running pod. Times at which only one of the three sources has a row are kept.
    """
    counter = series.select_series(metrics, series.CPU_COUNTER, real_containers=True)
    working_set = series.select_series(metrics, series.WORKING_SET, real_containers=True)
    keys = ["strategy", "timestamp"]

    def whole(df, name):
        # rounded first, so that the order of summation does not decide
        return df.select("strategy", F.col("step").alias("timestamp"), F.round(name, 6).cast("bigint").alias(name))

    live = whole(series.live_count(series.select_series(metrics, series.UP), interval_seconds), "live")
    cpu = whole(series.cpu_millicores(series.counter_rate(counter), interval_seconds), "cpu_millicores")
    memory = whole(series.memory_mib(working_set, interval_seconds), "memory_mib")
    readings = usage.sample_fallback(cpu.join(memory, keys, "full"), dump, keys)

    def zeroed(name):
        return count_or_zero(F.col(name).cast("string"))

    found = live.join(readings, keys, "full").select(
        F.lit(run_id).alias("run_id"),
        *keys,
        zeroed("live").cast("int").alias("executor_count"),
        zeroed("cpu_millicores").cast("double").alias("cpu_millicores"),
        zeroed("memory_mib").cast("double").alias("memory_mib"),
    )
    # written, since the start of a series and its samples both read it
    return started_samples(written(found.filter(F.col("strategy").isNotNull()), "built"))

"""Resource samples -> cost, latency and utilisation per run and strategy.

A series is one (run_id, strategy). Sums and peaks are plain aggregates. Where the order of
samples matters, a series is first folded to one row per second and cut into slices of time, whose
summaries are merged: no window is wider than a slice.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.frames import salted_join
from ledgerline.functions.scalars import (
    EXECUTOR_MIB,
    EXECUTOR_MILLICORES,
    cost_rate,
    non_negative,
    percent,
    strategy_label,
)

SERIES = ["run_id", "strategy"]
INTERVAL_SECONDS = 10
#: Width of the slices in which the order of samples is looked at, and the limit of an array's length.
SLICE_SECONDS = 86_400
MOST_PARTS = 1 << 30
SUMMARY_COLUMNS = [
    "run_id", "strategy", "duration_seconds", "observed_seconds",
    "scale_up_latency_seconds", "scale_down_time_seconds",
    "avg_executor_count", "avg_cpu_utilisation_pct", "avg_cpu_millicores", "avg_memory_mib",
    "peak_executor_count", "peak_cpu_millicores",
    "simulated_cost_usd", "cpu_efficiency_pct", "memory_efficiency_pct",
]

# The compared metrics with their better direction, and the order that breaks ties.
COMPARED = [
    ("scale_up_latency_seconds", "lower"),
    ("peak_executor_count", "lower"),
    ("avg_cpu_utilisation_pct", "higher"),
    ("scale_down_time_seconds", "lower"),
    ("simulated_cost_usd", "lower"),
]
TIE_ORDER = ["dynamic", "keda", "hpa", "dra"]


def billed_rate(strict=True):
    """Cost rate of a sample; one without any reading is billed by its executors.

    ``strict`` makes a negative one among the billed figures an error that names its field.
    """
    cpu, memory = F.col("cpu_millicores"), F.col("memory_mib")
    observed = (cpu > 0) | (memory > 0)
    executors = F.col("executor_count").cast("double")
    billed_cpu = F.when(observed, cpu).otherwise(executors * EXECUTOR_MILLICORES)
    billed_memory = F.when(observed, memory).otherwise(executors * EXECUTOR_MIB)
    if strict:
        billed_cpu = non_negative(billed_cpu, "cpu_millicores")
        billed_memory = non_negative(billed_memory, "memory_mib")
    return cost_rate(billed_cpu, billed_memory)


def cpu_utilisation():
    """Percent of the provisioned CPU in use; null for a sample without executors."""
    provisioned = F.col("executor_count") * EXECUTOR_MILLICORES
    share = F.try_divide(F.col("cpu_millicores"), provisioned) * 100
    return F.when(F.col("executor_count") > 0, percent(share))


def series_totals(samples: DataFrame, interval_seconds=INTERVAL_SECONDS, strict=True) -> DataFrame:
    """Everything about a series that does not depend on the order of its samples."""
    totals = samples.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("sample_count"),
        (F.max("timestamp") - F.min("timestamp")).alias("observed_seconds"),
        F.avg("executor_count").alias("avg_executor_count"),
        F.coalesce(F.avg(cpu_utilisation()), F.lit(0.0)).alias("avg_cpu_utilisation_pct"),
        F.avg("cpu_millicores").alias("avg_cpu_millicores"),
        F.avg("memory_mib").alias("avg_memory_mib"),
        F.max("executor_count").alias("peak_executor_count"),
        F.max("cpu_millicores").alias("peak_cpu_millicores"),
        (F.sum(billed_rate(strict)) * interval_seconds).alias("simulated_cost_usd"),
    )
    peak = F.col("peak_executor_count")

    def of_peak(used, unit):
        return F.when(peak > 0, F.try_divide(F.col(used), peak * unit) * 100).otherwise(0.0)

    return totals.withColumns(
        {
            "duration_seconds": F.col("sample_count") * interval_seconds,
            "cpu_efficiency_pct": of_peak("avg_cpu_millicores", EXECUTOR_MILLICORES),
            "memory_efficiency_pct": of_peak("avg_memory_mib", EXECUTOR_MIB),
        }
    )


def scaling_parts(samples: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """What each slice of a series tells about scaling, in a form that neighbours can be merged in.

    Samples of one second count as its highest executor count. A part holds its first second, its records (the seconds
    with more executors than any before them in the part: one row per executor count at most), its last peak and the
    second after it. The only window is as wide as a slice.
    """
    seconds = samples.groupBy(*SERIES, "timestamp").agg(F.max("executor_count").alias("executors"))
    sliced = seconds.withColumn("slice", F.floor(F.col("timestamp") / slice_seconds))
    order = Window.partitionBy(*SERIES, "slice").orderBy("timestamp")
    so_far = F.max("executors").over(order.rowsBetween(Window.unboundedPreceding, -1))
    walked = sliced.select(
        *SERIES, "slice", "timestamp", "executors",
        (F.col("executors").isNotNull() & F.coalesce(F.col("executors") > so_far, F.lit(True))).alias("record"),
        F.lead("timestamp").over(order).alias("next_timestamp"),
    )
    peak = F.max(F.struct("executors", "timestamp", "next_timestamp"))
    record = F.when(F.col("record"), F.struct("timestamp", "executors"))
    return walked.groupBy(*SERIES, "slice").agg(
        F.min("timestamp").alias("from_timestamp"), F.array_sort(F.collect_list(record)).alias("records"), peak.alias("peak")
    )


def _joined(before, after):
    """One part from two neighbours; the order in which parts are joined does not matter."""
    highest = F.get(before["records"], F.size(before["records"]) - 1)["executors"]
    higher = F.filter(after["records"], lambda record: F.coalesce(record["executors"] > highest, F.lit(True)))
    earlier, later = before["peak"]["executors"], after["peak"]["executors"]
    left = F.struct(
        before["peak"]["executors"].alias("executors"),
        before["peak"]["timestamp"].alias("timestamp"),
        F.coalesce(before["peak"]["next_timestamp"], after["from_timestamp"]).alias("next_timestamp"),
    )
    return F.struct(
        before["from_timestamp"].alias("from_timestamp"),
        F.concat(before["records"], higher).alias("records"),
        F.when(F.coalesce(later >= earlier, earlier.isNull()), after["peak"]).otherwise(left).alias("peak"),
    )


SCALING_PART = ["from_timestamp", "records", "peak"]


def merged_parts(parts: DataFrame, keys=SERIES, fields=SCALING_PART, join=_joined) -> DataFrame:
    """Neighbouring parts of each of ``keys`` as one part; merged parts can be merged again.

    Parts are put in order by their first field. ``join`` makes one of two neighbours.
    """
    return (
        parts.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
        .select(*keys, F.reduce(F.slice("parts", 2, MOST_PARTS), F.get("parts", F.lit(0)), join).alias("part"))
        .select(*keys, "part.*")
    )


def scaling_of(parts: DataFrame) -> DataFrame:
    """Scaling times of whole series, one part each: from the first running record to the next, and from the last peak down."""
    running = F.filter("records", lambda record: record["executors"] > 0)
    grown = F.get(running, F.lit(1))["timestamp"] - F.get(running, F.lit(0))["timestamp"]
    return parts.select(
        *SERIES,
        grown.cast("double").alias("scale_up_latency_seconds"),
        (F.col("peak.next_timestamp") - F.col("peak.timestamp")).cast("double").alias("scale_down_time_seconds"),
    )


def scaling_times(samples: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """Seconds from the first running executors to the first growth, and from the last peak down.

    Samples of one second count as its highest executor count; later means a later second. Slices of a series are
    summed up apart and merged, so a series that holds a third of all samples is many tasks' work.
    """
    return scaling_of(merged_parts(scaling_parts(samples, slice_seconds)))


def started_samples(samples: DataFrame) -> DataFrame:
    """Samples from the first second with running executors on; a series without any has none."""
    first_running = F.min(F.when(F.col("executor_count") > 0, F.col("timestamp")))
    starts = samples.groupBy(*SERIES).agg(first_running.alias("started")).filter("started IS NOT NULL")
    return salted_join(samples, starts, SERIES, ["timestamp", "cpu_millicores"]).filter(F.col("timestamp") >= F.col("started")).drop("started")


def cost_summary(samples: DataFrame, interval_seconds=INTERVAL_SECONDS, strict=True) -> DataFrame:
    totals = series_totals(samples, interval_seconds, strict)
    return totals.join(scaling_times(samples), SERIES, "left").select(*SUMMARY_COLUMNS)


def compare_strategies(samples: DataFrame, interval_seconds=INTERVAL_SECONDS, strict=True) -> DataFrame:
    """Summaries of each run, cheapest strategy first."""
    return cost_summary(samples, interval_seconds, strict).orderBy("run_id", "simulated_cost_usd", "strategy")


def metric_winners(summary: DataFrame) -> DataFrame:
    """Best strategy per run and metric, on values rounded to 4 digits; ties by ``TIE_ORDER``.

    The first, finer rounding keeps the summation order out of the second.
    """
    metrics = [name for name, _ in COMPARED]
    higher = [name for name, better in COMPARED if better == "higher"]
    values = [F.col(name).cast("double").alias(name) for name in metrics]
    long = summary.select(*SERIES, *values).unpivot(SERIES, metrics, "metric", "value")
    value = F.round(F.round("value", 10), 4)
    signed = F.when(F.col("metric").isin(higher), -value).otherwise(value)
    place = F.array_position(F.array(*[F.lit(name) for name in TIE_ORDER]), F.col("strategy"))
    best = F.min(F.struct(signed.alias("signed"), place.alias("place"), "strategy", value.alias("value")))
    return (
        long.filter(F.col("value").isNotNull() & F.col("strategy").isin(TIE_ORDER))
        .groupBy("run_id", "metric")
        .agg(best.alias("best"))
        .select(
            "run_id",
            "metric",
            F.col("best.strategy").alias("winner"),
            strategy_label(F.col("best.strategy")).alias("label"),
            F.col("best.value").alias("value"),
        )
    )


def run_superlatives(summary: DataFrame) -> DataFrame:
    """Cheapest, shortest, leanest and best used strategy of runs with at least two; ties go to the cheaper."""

    def first_by(value):
        key = F.struct(value.alias("value"), F.col("simulated_cost_usd"), F.col("strategy"))
        return F.min(key).getField("strategy")

    return (
        summary.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("strategies"),
            first_by(F.col("simulated_cost_usd")).alias("most_cost_efficient"),
            first_by(F.col("duration_seconds")).alias("fastest_job"),
            first_by(F.col("avg_executor_count")).alias("fewest_avg_executors"),
            first_by(-F.col("avg_cpu_utilisation_pct")).alias("highest_avg_cpu_util"),
        )
        .filter(F.col("strategies") >= 2)
    )


def dead_metrics(samples: DataFrame) -> DataFrame:
    """Runs whose CPU or memory readings are all zero point at a missing metrics source."""
    cpu, memory = F.col("cpu_millicores"), F.col("memory_mib")
    return (
        samples.groupBy("run_id")
        .agg(
            F.count_if(cpu != 0).alias("live_cpu_samples"),
            F.count_if(memory != 0).alias("live_memory_samples"),
            F.bool_and(cpu == 0).alias("all_cpu_zero"),
            F.bool_and(memory == 0).alias("all_memory_zero"),
        )
        .withColumn("warning", F.col("all_cpu_zero") | F.col("all_memory_zero"))
    )


def _by_minute(samples: DataFrame, lateness, figures) -> DataFrame:
    stamped = samples.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", lateness)
    minutes = stamped.groupBy(F.window("at", "1 minute").alias("minute"), "strategy").agg(*figures)
    start, end = F.unix_timestamp("minute.start"), F.unix_timestamp("minute.end")
    return minutes.select(start.alias("minute_start"), end.alias("minute_end"), "strategy", *minutes.columns[2:])


def minute_rollup(samples: DataFrame, interval_seconds=INTERVAL_SECONDS, lateness="30 seconds") -> DataFrame:
    """Peak, average and cost per minute and strategy; the same code in batch and on a stream."""
    return _by_minute(
        samples,
        lateness,
        [
            F.count(F.lit(1)).alias("sample_count"),
            F.max("executor_count").alias("peak_executor_count"),
            F.avg("executor_count").alias("avg_executor_count"),
            F.avg("cpu_millicores").alias("avg_cpu_millicores"),
            F.avg("memory_mib").alias("avg_memory_mib"),
            (F.sum(billed_rate()) * interval_seconds).alias("simulated_cost_usd"),
        ],
    )


AVERAGED = {"executor_count": "avg_executor_count", "cpu_millicores": "avg_cpu_millicores", "memory_mib": "avg_memory_mib"}


def minute_parts(samples: DataFrame, interval_seconds=INTERVAL_SECONDS) -> DataFrame:
    """The rollup of some of the samples, in figures that add up: counts, sums and the peak."""
    figures = [F.count(F.lit(1)).alias("sample_count"), F.max("executor_count").alias("peak_executor_count")]
    for name in AVERAGED:
        figures += [F.sum(F.col(name).cast("double")).alias(f"{name}_sum"), F.count(name).alias(f"{name}_known")]
    figures.append((F.sum(billed_rate()) * interval_seconds).alias("simulated_cost_usd"))
    figures.append(F.max("timestamp").alias("last_timestamp"))
    return _by_minute(samples, "0 seconds", figures)


def merged_minutes(parts: DataFrame) -> DataFrame:
    """``minute_rollup`` of all samples that went into ``parts``, in whatever pieces and order."""
    averages = [
        F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_known")).alias(out) for name, out in AVERAGED.items()
    ]
    return parts.groupBy("minute_start", "minute_end", "strategy").agg(
        F.sum("sample_count").alias("sample_count"),
        F.max("peak_executor_count").alias("peak_executor_count"),
        *averages,
        F.sum("simulated_cost_usd").alias("simulated_cost_usd"),
    )

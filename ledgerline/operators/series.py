"""Metric series by pod: counter rates, gauges, liveness, threshold breaches.

Metrics are long rows (metric, pod, container, area, ts, value), ts in epoch seconds. A series
is folded to one row per second and cut into slices of time before any window; a slice sees as much
of its neighbours as its windows need.
"""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.shared import written

# Metric names, pod name prefixes, thresholds of the two autoscalers.
CPU_COUNTER = "container_cpu_usage_seconds_total"
PROCESS_CPU_COUNTER = "process_cpu_seconds_total"
WORKING_SET = "container_memory_working_set_bytes"
HEAP_USED = "jvm_memory_bytes_used"
HEAP_MAX = "jvm_memory_bytes_max"
UP = "up"
POD_PREFIXES = {
    "spark-dynamic": "dra",
    "spark-worker-keda": "keda",
    "spark-worker-hpa": "hpa",
}
THRESHOLDS = [
    ("keda", "heap_pct", 65.0),
    ("keda", "cpu_pct", 70.0),
    ("hpa", "heap_pct", 65.0),
    ("hpa", "cpu_millicores", 700.0),
]

POD_SERIES = ["pod", "container"]

STEP_SECONDS = 10
RATE_LOOKBACK = 60
GAUGE_LOOKBACK = 300
SLICE_SECONDS = 86_400


def select_series(metrics, metric, pods=None, pod_prefix=None, area=None, real_containers=False) -> DataFrame:
    """Label filters. ``pods`` is a list of names, or a DataFrame with a ``pod`` column for many."""
    out = metrics.filter(F.col("metric") == metric)
    if isinstance(pods, DataFrame):
        out = out.join(pods.select("pod").distinct(), "pod", "left_semi")
    elif pods is not None:
        out = out.filter(F.col("pod").isin(list(pods)))
    if pod_prefix is not None:
        out = out.filter(F.col("pod").rlike(f"^{re.escape(pod_prefix)}.*$"))
    if area is not None:
        out = out.filter(F.col("area") == area)
    if real_containers:
        out = out.filter((F.col("container") != "") & (F.col("container") != "POD"))
    return out


def pod_strategy(pod):
    strategy = F.lit(None).cast("string")
    for prefix, name in POD_PREFIXES.items():
        strategy = F.when(pod.startswith(prefix), name).otherwise(strategy)
    return strategy


def _slice(ts, slice_seconds):
    return F.floor(ts / slice_seconds)


def _in_slices(rows: DataFrame, first, last) -> DataFrame:
    """Each row once in every slice from ``first`` to ``last``, its own among them; ``halo`` marks the others."""
    spread = rows.select("*", F.explode(F.sequence(first, last)).alias("in_slice"))
    return spread.withColumn("halo", F.col("in_slice") != F.col("slice")).drop("slice").withColumnRenamed("in_slice", "slice")


def counter_steps(counter: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """pod, container, ts, value, step, previous_ts: the increase of each second's reading over the one before.

    A drop is a restart from 0; the first reading has no step. Readings are walked in slices of time. The last
    reading of a slice is also put before the next slice that has any, so that no window is wider than a slice.
    """
    seconds = counter.groupBy(*POD_SERIES, "ts").agg(F.max("value").alias("value")).withColumn("slice", _slice(F.col("ts"), slice_seconds))
    lasts = seconds.groupBy(*POD_SERIES, "slice").agg(F.max(F.struct("ts", "value")).alias("last"))
    following = F.lead("slice").over(Window.partitionBy(*POD_SERIES).orderBy("slice"))
    carried = lasts.withColumn("slice", following).filter("slice IS NOT NULL").select(*POD_SERIES, "last.*", "slice", F.lit(True).alias("halo"))
    order = Window.partitionBy(*POD_SERIES, "slice").orderBy("ts")
    value, previous = F.col("value"), F.lag("value").over(order)
    walked = seconds.withColumn("halo", F.lit(False)).unionByName(carried).select(
        *POD_SERIES, "ts", "value", "slice", "halo",
        F.when(value < previous, value).otherwise(value - previous).alias("step"),
        F.lag("ts").over(order).alias("previous_ts"),
    )
    return walked.filter("NOT halo").drop("halo")


def counter_rate(counter: DataFrame, window_seconds=60, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """Per sample: increase since the one before (a drop is a restart from 0) and trailing rate.

    The rate is the increase over the samples of the window divided by the time they cover;
    it is not extrapolated to the window's edges, and null where no increase is known.
    """
    steps = counter_steps(counter, slice_seconds).withColumn("covered", F.col("ts") - F.col("previous_ts"))
    around = _in_slices(steps, F.col("slice"), _slice(F.col("ts") + window_seconds - 1, slice_seconds))
    trailing = Window.partitionBy(*POD_SERIES, "slice").orderBy("ts").rangeBetween(-(window_seconds - 1), 0)
    return (
        around.select(
            *POD_SERIES,
            "ts",
            "value",
            F.coalesce("step", F.lit(0.0)).alias("increase"),
            F.try_divide(F.sum("step").over(trailing), F.sum("covered").over(trailing)).alias("rate"),
            "halo",
        )
        .filter("NOT halo")
        .drop("halo")
    )


def extrapolated_rate(counter: DataFrame, window_seconds=60, step_seconds=STEP_SECONDS, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """pod, container, step, samples, increase, rate: the rate over the window that ends at each step of a time grid.

    The increase between the first and the last sample of the window (a drop is a restart from 0) is carried on to the
    window's edges, as monitoring systems do: by the time to an edge if that is less than 1.1 mean gaps, else by
    half a mean gap; and back no further than to where the counter would have been 0. A window of one sample has no
    rate. Each sample is laid on the at most window_seconds / step_seconds steps whose windows hold it.
    """
    width, step, least = F.lit(window_seconds), F.col("step"), F.lit(1.1)
    first_step = F.ceil(F.col("ts") / step_seconds) * step_seconds
    last_step = F.floor((F.col("ts") + window_seconds - 1) / step_seconds) * step_seconds
    laid = (
        counter_steps(counter, slice_seconds)
        .withColumnRenamed("step", "grown")
        .withColumns({"first_step": first_step, "last_step": last_step})
        .filter("first_step <= last_step")
        .withColumn("step", F.explode(F.sequence("first_step", "last_step", F.lit(step_seconds).cast("long"))))
    )
    inside = F.col("previous_ts") > step - width
    windows = laid.groupBy(*POD_SERIES, "step").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min(F.struct("ts", "value")).alias("first"),
        F.max("ts").alias("last_ts"),
        F.sum(F.when(inside, F.col("grown"))).alias("increase"),
    )
    first, increase = F.col("first.value"), F.col("increase")
    covered = (F.col("last_ts") - F.col("first.ts")).cast("double")
    gap = F.try_divide(covered, F.col("samples") - 1)
    to_start, to_end = F.col("first.ts") - (step - width), step - F.col("last_ts")
    before = F.when(to_start >= gap * least, gap / 2).otherwise(to_start)
    to_zero = F.when((increase > 0) & (first >= 0), F.try_divide(covered * first, increase))
    after = F.when(to_end >= gap * least, gap / 2).otherwise(to_end)
    carried = F.try_divide(increase * (covered + F.least(before, to_zero) + after), covered * window_seconds)
    return windows.select(*POD_SERIES, "step", "samples", "increase", F.when(F.col("samples") > 1, carried).alias("rate"))


def instant_values(df: DataFrame, keys, value, lookback, step_seconds=STEP_SECONDS, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """keys, step, value: what each series shows at every step of a time grid.

    That is its newest known reading of the last ``lookback`` seconds (the step's own second included); a
    series that is silent for longer shows nothing. ``df`` has one row per key and second. Each reading is
    laid on the steps from its own time to the next reading's, at most lookback / step_seconds rows. The next reading
    matters only within the lookback, so each slice of time sees that much of the one after it.
    """
    order = Window.partitionBy(*keys, "slice").orderBy("ts")

    def step_from(ts):
        return F.ceil(ts / step_seconds) * step_seconds

    known = df.filter(F.col(value).isNotNull()).withColumn("slice", _slice(F.col("ts"), slice_seconds))
    around = _in_slices(known, _slice(F.col("ts") - lookback, slice_seconds), F.col("slice"))
    walked = around.withColumn("next_ts", F.lead("ts").over(order)).filter("NOT halo")
    last = F.least(F.col("ts") + lookback - 1, step_from(F.col("next_ts")) - 1)
    spread = walked.select(
        *keys, value, step_from(F.col("ts")).alias("first"), (F.floor(last / step_seconds) * step_seconds).alias("last")
    ).filter("first <= last")
    return spread.select(*keys, F.explode(F.sequence("first", "last", F.lit(step_seconds).cast("long"))).alias("step"), value)


def cpu_millicores(rates: DataFrame, step_seconds=STEP_SECONDS, lookback=RATE_LOOKBACK) -> DataFrame:
    """Millicores in use per strategy at every step: the newest rate of each container, summed."""
    per_pod = instant_values(rates, POD_SERIES, "rate", lookback, step_seconds)
    return per_pod.groupBy(pod_strategy(F.col("pod")).alias("strategy"), "step").agg(
        (F.sum("rate") * 1000).alias("cpu_millicores"),
        F.count(F.lit(1)).alias("series"),
    )


def memory_mib(working_set: DataFrame, step_seconds=STEP_SECONDS, lookback=GAUGE_LOOKBACK) -> DataFrame:
    """MiB in use per strategy at every step: newest reading of each container, summed; equal seconds keep the larger."""
    seconds = working_set.groupBy(*POD_SERIES, "ts").agg(F.max("value").alias("value"))
    per_pod = instant_values(seconds, POD_SERIES, "value", lookback, step_seconds)
    return per_pod.groupBy(pod_strategy(F.col("pod")).alias("strategy"), "step").agg(
        (F.sum("value") / 1048576).alias("memory_mib"), F.count(F.lit(1)).alias("series")
    )


def heap_percent(metrics: DataFrame) -> DataFrame:
    """used / max * 100 of the heap per pod and second."""
    gauges = metrics.filter(F.col("metric").isin(HEAP_USED, HEAP_MAX) & (F.col("area") == "heap"))
    paired = gauges.groupBy("pod", "ts").agg(
        F.max(F.when(F.col("metric") == HEAP_USED, F.col("value"))).alias("used"),
        F.max(F.when(F.col("metric") == HEAP_MAX, F.col("value"))).alias("limit"),
    )
    return paired.select("pod", "ts", (F.try_divide("used", "limit") * 100).alias("heap_pct"))


def heap_pct(metrics: DataFrame) -> DataFrame:
    return heap_percent(metrics).groupBy("pod").agg(F.avg("heap_pct").alias("heap_pct"))


def heap_pct_by_strategy(metrics: DataFrame, step_seconds=STEP_SECONDS, lookback=GAUGE_LOOKBACK) -> DataFrame:
    """Heap use per strategy at every step, averaged over the newest readings of its pods."""
    per_pod = instant_values(heap_percent(metrics), ["pod"], "heap_pct", lookback, step_seconds)
    return per_pod.groupBy(pod_strategy(F.col("pod")).alias("strategy"), "step").agg(F.avg("heap_pct").alias("heap_pct"))


def heap_bytes(metrics: DataFrame, pod_prefix=None) -> DataFrame:
    return select_series(metrics, HEAP_USED, pod_prefix=pod_prefix, area="heap").select("pod", "ts", "value")


def live_count(up: DataFrame, step_seconds=STEP_SECONDS, lookback=GAUGE_LOOKBACK) -> DataFrame:
    """Pods that are up at every step, per strategy, by the newest reading of each pod."""
    seconds = up.groupBy("pod", "ts").agg(F.max("value").alias("value"))
    per_pod = instant_values(seconds, ["pod"], "value", lookback, step_seconds)
    return per_pod.groupBy(pod_strategy(F.col("pod")).alias("strategy"), "step").agg(
        F.sum("value").cast("bigint").alias("live")
    )


def executor_lifecycle(up: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """Spans of unchanged liveness per pod."""
    seconds = up.groupBy("pod", "ts").agg(F.max("value").alias("value")).withColumn("up", F.col("value").cast("int"))
    spans = sliced_spans(seconds, ["pod"], "ts", "value", slice_seconds, {"up": F.max})
    return spans.select("pod", "up", "span_start", "span_end", "readings")


def sliced_spans(rows: DataFrame, keys, ts, state, slice_seconds, folded=None) -> DataFrame:
    """Spans of rows whose ``state`` equals their predecessor's: keys, state, span_start, span_end, readings, folded.

    Spans are found inside slices of time, so no task holds more than a slice of a key. Only the first and
    last span of a slice can go on in another one; these, two rows a slice, are then joined in order.
    ``folded`` names columns with the aggregate that carries each of them over a span, and over spans.
    """
    folded = {name: how(name).alias(name) for name, how in (folded or {}).items()}
    sliced = rows.withColumn("slice", _slice(F.col(ts), slice_seconds))
    order = Window.partitionBy(*keys, "slice").orderBy(ts)
    changed = F.when(F.lag(state).over(order).eqNullSafe(F.col(state)) & F.lag(ts).over(order).isNotNull(), 0).otherwise(1)
    numbered = sliced.withColumn("changed", changed).withColumn(
        "span", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = numbered.groupBy(*keys, "slice", "span", state).agg(
        F.min(ts).alias("span_start"), F.max(ts).alias("span_end"), F.count(F.lit(1)).alias("readings"), *folded.values()
    )
    edged = inside.withColumn("closes", F.col("span") == F.max("span").over(Window.partitionBy(*keys, "slice")))
    opens = F.col("span") == 1
    whole = Window.partitionBy(*keys).orderBy("span_start")
    goes_on = opens & F.coalesce(F.lag("closes").over(whole), F.lit(False)) & F.lag(state).over(whole).eqNullSafe(F.col(state))
    ends = edged.filter(opens | F.col("closes")).withColumn("new", F.when(goes_on, 0).otherwise(1))
    chains = ends.withColumn("chain", F.sum("new").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chains.groupBy(*keys, "chain", state).agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.sum("readings").alias("readings"), *folded.values()
    )
    shape = [*keys, state, "span_start", "span_end", "readings", *folded]
    return edged.filter(~opens & ~F.col("closes")).select(*shape).unionByName(joined.select(*shape))


def autoscaler_readings(metrics: DataFrame, step_seconds=STEP_SECONDS) -> DataFrame:
    """What the autoscalers look at, on a time grid: (strategy, signal, step, value), averaged over pods."""
    heap = instant_values(heap_percent(metrics), ["pod"], "heap_pct", GAUGE_LOOKBACK, step_seconds).select(
        "pod", "step", F.lit("heap_pct").alias("signal"), F.col("heap_pct").alias("value")
    )
    counter = select_series(metrics, CPU_COUNTER, real_containers=True)
    rates = instant_values(counter_rate(counter), POD_SERIES, "rate", RATE_LOOKBACK, step_seconds)
    per_pod = rates.groupBy("pod", "step").agg(F.sum("rate").alias("rate"))
    cpu = per_pod.select(
        "pod",
        "step",
        F.inline(
            F.array(
                F.struct(F.lit("cpu_pct").alias("signal"), (F.col("rate") * 100).alias("value")),
                F.struct(F.lit("cpu_millicores").alias("signal"), (F.col("rate") * 1000).alias("value")),
            )
        ),
    )
    return (
        heap.unionByName(cpu)
        .groupBy(pod_strategy(F.col("pod")).alias("strategy"), "signal", "step")
        .agg(F.avg("value").alias("value"))
    )


def thresholds(spark) -> DataFrame:
    rows = ", ".join(f"('{s}', '{m}', {limit}D)" for s, m, limit in THRESHOLDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(strategy, signal, threshold)")


def threshold_breaches(readings: DataFrame, limits: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """Spans of consecutive readings above the threshold, with their length and peak.

    The judged readings are written first: finding the spans inside slices and joining their ends read them twice.
    """
    signal = ["strategy", "signal", "threshold"]
    judged = readings.join(limits, ["strategy", "signal"]).select(
        *signal, "step", "value", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).alias("breached")
    )
    spans = sliced_spans(written(judged, "judged"), signal, "step", "breached", slice_seconds, {"value": F.max})
    renamed = {"span_start": "breach_start", "span_end": "breach_end", "value": "peak"}
    return spans.filter("breached").drop("breached").withColumnsRenamed(renamed)


def series_exists(metrics: DataFrame, metric, **labels) -> bool:
    return not select_series(metrics, metric, **labels).isEmpty()


def metric_presence(metrics: DataFrame) -> DataFrame:
    """Readings and series per metric; a metric without any row has no series."""
    pods = metrics.groupBy("metric", "pod").agg(F.count(F.lit(1)).alias("readings"))
    return pods.groupBy("metric").agg(
        F.sum("readings").alias("readings"), F.count(F.lit(1)).alias("pods")
    )

"""Validation of samples and of whole runs. Failing is a result here, not an exception."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.frames import require_columns
from ledgerline.functions.scalars import (
    PLAIN_COUNT_TEXT,
    strategy_name,
    strict_decimal,
    strict_integer,
)
from ledgerline.operators.samples import INTERVAL_SECONDS, SERIES, SLICE_SECONDS, billed_rate, merged_parts
from ledgerline.schemas import SAMPLE_COLUMNS

# Names, ranges and limits that a sample or a run is held to.
KNOWN_STRATEGIES = ["dra", "dynamic", "keda", "hpa"]
COMPLETE_RUN = ["dra", "keda", "hpa"]
EXECUTOR_RANGE = (0, 10)
MIN_SAMPLES = 30
GAPS_MEASURED = 10
GAP_SECONDS = (8, 15)
MAX_EXECUTORS = 3
IDLE_SAMPLES = 12
SCALE_UP_SAMPLES = {"dra": 3, "keda": 4, "hpa": 4}
COST_RANGE = (0.0001, 1.00)
RUN_FILE = r"^(\d{8}-\d{6,})-(.+)\.csv$"


def run_of_file(name):
    """Run id and mode from a results file name such as 20260101-120000-top_games.csv."""
    return F.regexp_extract(name, RUN_FILE, 1), F.regexp_extract(name, RUN_FILE, 2)


def with_run(raw: DataFrame, *more) -> DataFrame:
    """Rows of a file source with the file they came from and the run and mode its name stands for, and ``more`` columns."""
    run_id, mode = run_of_file(F.col("file"))
    return (
        raw.select(*raw.columns, *more, F.col("_metadata.file_name").alias("file"))
        .withColumn("run_id", F.when(run_id == "", F.col("file")).otherwise(run_id))
        .withColumn("mode", mode)
    )


def sample_rules(rules="load"):
    """(valid, reasons, typed columns) of a sample row in text.

    ``rules="load"`` asks for numbers only and cleans the strategy name; ``rules="full"`` also
    asks for a known strategy exactly as written and for plausible ranges. ``valid`` reads each
    field once, so that filtering by it stays cheap; ``reasons`` says all that is wrong.
    """
    executors = strict_integer(F.col("executor_count"), "int")
    cpu = strict_decimal(F.col("cpu_millicores"))
    memory = strict_decimal(F.col("memory_mib"))
    stamp = strict_integer(F.col("timestamp"))
    reasons = [
        (F.col("strategy").isNull(), "missing strategy"),
        (stamp.isNull(), "non-numeric timestamp"),
        (executors.isNull(), "non-numeric executor_count"),
        (cpu.isNull(), "non-numeric cpu_millicores"),
        (memory.isNull(), "non-numeric memory_mib"),
    ]
    if rules == "full":
        known = F.col("strategy").isin(KNOWN_STRATEGIES)
        reasons += [
            (~known, "unknown strategy"),
            (~executors.between(*EXECUTOR_RANGE), "executor_count out of range"),
            (cpu < 0, "negative cpu_millicores"),
            (memory < 0, "negative memory_mib"),
        ]
        in_range = (executors >= EXECUTOR_RANGE[0]) & (executors <= EXECUTOR_RANGE[1])
        valid = known & stamp.isNotNull() & in_range & (cpu >= 0) & (memory >= 0)
    else:
        present = F.col("strategy").isNotNull() & stamp.isNotNull() & executors.isNotNull()
        valid = present & cpu.isNotNull() & memory.isNotNull()
    typed = {
        "strategy": strategy_name(F.col("strategy")),
        "timestamp": stamp,
        "executor_count": executors,
        "cpu_millicores": cpu,
        "memory_mib": memory,
    }
    texts = [F.when(wrong, F.lit(text)) for wrong, text in reasons]
    return F.coalesce(valid, F.lit(False)), F.concat_ws("; ", *texts), typed


def split_samples(raw: DataFrame, rules="load") -> tuple[DataFrame, DataFrame]:
    """(good, rejects); rejects keep the text as it came, with the reasons."""
    require_columns(raw, SAMPLE_COLUMNS, "samples")
    valid, reasons, typed = sample_rules(rules)
    return raw.filter(valid).withColumns(typed), raw.filter(~valid).withColumn("reasons", reasons)


def labelled_samples(raw: DataFrame, rules="load") -> DataFrame:
    """All rows in one frame, for a sink that separates them by ``outcome``.

    Good rows carry the typed columns; rejected ones carry ``as_read``, the row as it came, and the reasons.
    """
    require_columns(raw, SAMPLE_COLUMNS, "samples")
    valid, reasons, typed = sample_rules(rules)
    others = [F.col(name) for name in raw.columns if name not in SAMPLE_COLUMNS]
    return raw.select(
        *others,
        *[F.when(valid, column).alias(name) for name, column in typed.items()],
        F.when(~valid, F.struct(*raw.columns)).alias("as_read"),
        F.when(~valid, reasons).alias("reasons"),
        F.when(valid, "good").otherwise("rejected").alias("outcome"),
    )


def unlabelled_samples(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of ``labelled_samples``, shaped as by ``split_samples``."""
    good = labelled.filter(F.col("outcome") == "good").drop("as_read", "reasons", "outcome")
    rejects = labelled.filter(F.col("outcome") == "rejected").select("as_read.*", "reasons")
    return good, rejects


def reading_warnings(raw: DataFrame, fields=("executor_count", "cpu_millicores", "memory_mib")) -> DataFrame:
    """Per field, how many readings are not made of digits only and therefore count as 0."""
    bad = [
        F.count_if(~F.coalesce(F.col(name).rlike(PLAIN_COUNT_TEXT), F.lit(False))).alias(name)
        for name in fields
    ]
    return raw.agg(*bad).unpivot([], list(fields), "field", "zeroed_readings")


def complete_runs(raw: DataFrame) -> DataFrame:
    """One row per results file: readable, and holding all three strategies?"""
    require_columns(raw, SAMPLE_COLUMNS, "samples")
    valid, _, _ = sample_rules()
    strategy = strategy_name(F.col("strategy"))
    held = [F.bool_or(strategy == name) for name in COMPLETE_RUN]
    run_id, mode = run_of_file(F.col("file"))
    return (
        raw.groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.bool_and(valid).alias("readable"),
            F.coalesce(held[0] & held[1] & held[2], F.lit(False)).alias("has_all_strategies"),
        )
        .select(
            "file",
            run_id.alias("run_id"),
            mode.alias("mode"),
            "sample_count",
            "readable",
            "has_all_strategies",
            (F.col("readable") & F.col("has_all_strategies")).alias("complete"),
        )
    )


def newest_complete_run(raw: DataFrame) -> DataFrame:
    """The last complete file by name."""
    return complete_runs(raw).filter("complete").orderBy(F.desc("file")).limit(1)


def order_parts(samples: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """What each slice of a series tells about the order of its samples, in a form that neighbours can be merged in.

    Samples that share second and executor count are interchangeable, so they are counted into one row. A part holds its
    number of samples and of starved ones, its first samples (GAPS_MEASURED + 1 at most) and last ones (IDLE_SAMPLES at
    most), the highest executor count before these, and how many samples come before the first with more than one
    executor. The only window is as wide as a slice.
    """
    steps = (
        samples.groupBy(*SERIES, "timestamp", "executor_count")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("slice", F.floor(F.col("timestamp") / slice_seconds))
    )
    whole = Window.partitionBy(*SERIES, "slice")
    upto = F.sum("n").over(whole.orderBy("timestamp", "executor_count").rowsBetween(Window.unboundedPreceding, 0))
    placed = steps.withColumns({"upto": upto, "total": F.sum("n").over(whole)}).withColumn("start", F.col("upto") - F.col("n"))
    executors, start, total = F.col("executor_count"), F.col("start"), F.col("total")

    def bounded(most, kept):
        """Up to ``most`` equal samples of a row, as an array, where ``kept`` are wanted."""
        wanted = F.least(kept, F.lit(most)).cast("int")
        sample = F.struct("timestamp", F.col("executor_count").alias("executors"))
        return F.flatten(F.array_sort(F.collect_list(F.when(wanted > 0, F.array_repeat(sample, wanted)))))

    return placed.groupBy(*SERIES, "slice").agg(
        F.min("timestamp").alias("from_timestamp"),
        F.sum("n").alias("samples"),
        F.sum(F.when(executors < 1, F.col("n")).otherwise(0)).alias("starved"),
        bounded(GAPS_MEASURED + 1, F.least(F.col("n"), GAPS_MEASURED + 1 - start)).alias("head"),
        bounded(IDLE_SAMPLES, F.least(F.col("n"), F.col("upto") - (total - IDLE_SAMPLES))).alias("tail"),
        F.max(F.when(start < total - IDLE_SAMPLES, executors)).alias("active_max"),
        F.min(F.when(executors > 1, start)).alias("scale_up_at"),
    )


def _joined_order(before, after):
    """One part from two neighbours; the order in which parts are joined does not matter."""
    both = F.concat(before["tail"], after["tail"])
    left_out = F.greatest(F.lit(0), F.size(both) - IDLE_SAMPLES)
    pushed = F.array_max(F.transform(F.slice(both, 1, left_out), lambda sample: sample["executors"]))
    return F.struct(
        before["from_timestamp"].alias("from_timestamp"),
        (before["samples"] + after["samples"]).alias("samples"),
        (before["starved"] + after["starved"]).alias("starved"),
        F.slice(F.concat(before["head"], after["head"]), 1, GAPS_MEASURED + 1).alias("head"),
        F.slice(both, left_out + 1, IDLE_SAMPLES).alias("tail"),
        F.greatest(before["active_max"], after["active_max"], pushed).alias("active_max"),
        F.coalesce(before["scale_up_at"], before["samples"] + after["scale_up_at"]).alias("scale_up_at"),
    )


ORDER_PART = ["from_timestamp", "samples", "starved", "head", "tail", "active_max", "scale_up_at"]


def _order_facts(samples: DataFrame, slice_seconds=SLICE_SECONDS) -> DataFrame:
    """Head and tail facts per series, merged from its slices."""
    merged = merged_parts(order_parts(samples, slice_seconds), SERIES, ORDER_PART, _joined_order)
    executors = F.transform("tail", lambda sample: sample["executors"])
    head = F.transform("head", lambda sample: sample["timestamp"])
    starved_tail = F.size(F.filter(executors, lambda n: n < 1))
    return merged.select(
        *SERIES,
        F.try_divide((F.array_max(head) - F.array_min(head)).cast("double"), F.size(head) - 1).alias("mean_gap"),
        "scale_up_at",
        (F.col("starved") - starved_tail).alias("starved_samples"),
        F.array_min(executors).alias("idle_min"),
        "active_max",
    )


def _level_facts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.max("executor_count").alias("peak_executor_count"),
        (F.sum(billed_rate(strict=False)) * INTERVAL_SECONDS).alias("simulated_cost_usd"),
        F.count_if(F.col("cpu_millicores") < 0).alias("negative_cpu"),
        F.count_if(F.col("memory_mib") < 0).alias("negative_memory"),
    )


def _verdict(name, passed, observed, bound):
    return F.struct(
        F.lit(name).alias("check"),
        passed.alias("passed"),
        observed.cast("double").alias("observed"),
        (bound if not isinstance(bound, str) else F.lit(bound)).alias("bound"),
    )


def _span(limits):
    return f"{limits[0]} to {limits[1]}"


def run_checks(samples: DataFrame) -> DataFrame:
    """One row per (run, strategy, check); run-wide checks have a null strategy.

    ``passed`` is null where the check does not apply to the series.
    """
    levels = _level_facts(samples)
    facts = levels.join(_order_facts(samples), SERIES, "left")
    fact = {name: F.col(name) for name in facts.columns}
    strategy, cost, peak = fact["strategy"], fact["simulated_cost_usd"], fact["peak_executor_count"]
    known = strategy.isin(COMPLETE_RUN)
    long_enough = fact["sample_count"] > IDLE_SAMPLES
    allowed = F.lit(None).cast("int")
    for name, samples_allowed in SCALE_UP_SAMPLES.items():
        allowed = F.when(strategy == name, samples_allowed).otherwise(allowed)
    before_idle = F.when(strategy == "dra", peak).otherwise(fact["active_max"])
    per_series = [
        _verdict("min_samples", fact["sample_count"] >= MIN_SAMPLES, fact["sample_count"], f">= {MIN_SAMPLES}"),
        _verdict("sample_gap", fact["mean_gap"].between(*GAP_SECONDS), fact["mean_gap"], _span(GAP_SECONDS)),
        _verdict("cpu_not_negative", fact["negative_cpu"] == 0, fact["negative_cpu"], "0"),
        _verdict("memory_not_negative", fact["negative_memory"] == 0, fact["negative_memory"], "0"),
        _verdict("executor_cap", F.when(known, peak <= MAX_EXECUTORS), peak, f"<= {MAX_EXECUTORS}"),
        _verdict(
            "executor_floor", F.when(long_enough, fact["starved_samples"] == 0),
            F.when(long_enough, fact["starved_samples"]), "0",
        ),
        _verdict("scales_up", F.when(known, fact["scale_up_at"].isNotNull()), peak, "> 1"),
        _verdict(
            "scale_up_delay", fact["scale_up_at"] <= allowed, fact["scale_up_at"],
            F.concat(F.lit("<= "), allowed.cast("string")),
        ),
        _verdict(
            "scales_down", F.when(long_enough & known, fact["idle_min"] < before_idle),
            F.when(long_enough & known, fact["idle_min"]),
            F.when(long_enough & known, F.concat(F.lit("< "), before_idle.cast("string"))),
        ),
        _verdict("positive_cost", cost > 0, cost, "> 0"),
        _verdict("cost_range", cost.between(*COST_RANGE), cost, _span(COST_RANGE)),
    ]
    runs = levels.groupBy("run_id").agg(
        F.count_if(known).alias("held"),
        F.min(F.when(peak == MAX_EXECUTORS, cost)).alias("cheapest_full"),
        F.max(F.when(peak == 1, cost)).alias("dearest_single"),
    )
    per_run = [
        _verdict("strategies_present", F.col("held") == len(COMPLETE_RUN), F.col("held"), "3"),
        _verdict(
            "full_scale_costs_more", F.col("cheapest_full") > F.col("dearest_single"),
            F.when(F.col("dearest_single").isNotNull(), F.col("cheapest_full")), "> peak-1 cost",
        ),
    ]
    return (
        facts.select(*SERIES, F.inline(F.array(*per_series)))
        .unionByName(
            runs.select("run_id", F.lit(None).cast("string").alias("strategy"), F.inline(F.array(*per_run)))
        )
    )

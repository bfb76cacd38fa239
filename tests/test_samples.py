"""Cost summaries: hand-computed series, and a sequential checker on random ones."""

import random

import pytest

from pyspark.sql import functions as F

from ledgerline.functions.scalars import cost_rate, strategy_label
from ledgerline.operators import samples as ops

SCHEMA = "run_id string, strategy string, timestamp bigint, executor_count int, cpu_millicores double, memory_mib double"
NODE_SECOND = 0.09576 / 3600


def series(spark, *rows, run="r", strategy="keda"):
    return spark.createDataFrame([(run, strategy, t, e, float(c), float(m)) for t, e, c, m in rows], SCHEMA)


def summary(spark, *rows):
    return ops.cost_summary(series(spark, *rows)).collect()[0]


@pytest.mark.parametrize(
    "cpu, memory, nodes", [(0, 0, 0), (2000, 0, 1), (1000, 0, 0.5), (100, 4096, 0.5), (1500, 512, 0.75)]
)
def test_cost_rate(spark, cpu, memory, nodes):
    df = spark.createDataFrame([(float(cpu), float(memory))], "c double, m double")
    assert df.select(cost_rate(F.col("c"), F.col("m"))).first()[0] == pytest.approx(nodes * NODE_SECOND)


@pytest.mark.parametrize("job", [ops.cost_summary, ops.compare_strategies, ops.minute_rollup])
@pytest.mark.parametrize("cpu, memory, field", [(-1, 5, "cpu_millicores"), (5, -1, "memory_mib")])
def test_negative_readings_are_an_error(spark, job, cpu, memory, field):
    with pytest.raises(Exception, match=f"{field} is negative"):
        job(series(spark, (0, 1, cpu, memory))).collect()


def test_a_negative_reading_that_is_not_billed_is_none(spark):
    assert summary(spark, (0, 2, -1, 0))["simulated_cost_usd"] == pytest.approx(10 * NODE_SECOND)
    assert summary(spark, (0, 2, 0, -3))["simulated_cost_usd"] == pytest.approx(10 * NODE_SECOND)


def test_negative_readings_can_be_let_through(spark):
    row = ops.compare_strategies(series(spark, (0, 1, -500, 4096)), strict=False).collect()[0]
    assert row["simulated_cost_usd"] == pytest.approx(5 * NODE_SECOND)


def test_scale_up(spark):
    found = summary(spark, (0, 1, 500, 256), (10, 1, 600, 260), (20, 2, 1500, 700), (30, 2, 1400, 680))
    assert found["scale_up_latency_seconds"] == 20.0
    assert found["scale_down_time_seconds"] is None
    assert found["avg_cpu_utilisation_pct"] == pytest.approx(63.75)
    assert (found["duration_seconds"], found["observed_seconds"]) == (40, 30)


def test_scale_down(spark):
    found = summary(spark, (0, 1, 600, 300), (10, 3, 2400, 1500), (20, 3, 2200, 1400), (30, 2, 1200, 800))
    assert (found["scale_down_time_seconds"], found["scale_up_latency_seconds"]) == (10.0, 10.0)
    assert (found["peak_executor_count"], found["peak_cpu_millicores"]) == (3, 2400.0)


def test_utilisation_and_efficiency(spark):
    found = summary(spark, (0, 1, 500, 256), (10, 2, 1000, 512), (20, 2, 1500, 768))
    assert found["avg_cpu_utilisation_pct"] == pytest.approx(58.3333, abs=1e-4)
    assert found["cpu_efficiency_pct"] == pytest.approx(50.0)
    assert found["memory_efficiency_pct"] == pytest.approx(50.0)


def test_without_readings_executors_are_billed(spark):
    found = summary(spark, (0, 0, 0, 0), (10, 2, 0, 0), (20, 0, 0, 0))
    assert found["simulated_cost_usd"] == pytest.approx(0.000266)
    assert found["scale_up_latency_seconds"] is None
    assert found["scale_down_time_seconds"] == 10.0
    assert found["avg_cpu_utilisation_pct"] == 0.0


def test_duration(spark):
    assert summary(spark, *[(10 * i, 1, 1, 1) for i in range(12)])["duration_seconds"] == 120


def test_samples_start_with_the_first_running_executor(spark):
    df = series(spark, (0, 0, 9, 9), (10, 1, 1, 1), (20, 0, 1, 1)).unionAll(series(spark, (0, 0, 1, 1), strategy="dra"))
    assert sorted((r["strategy"], r["timestamp"]) for r in ops.started_samples(df).collect()) == [("keda", 10), ("keda", 20)]


def three(spark):
    parts = {"dra": (1, 500, 256), "keda": (2, 1800, 900), "hpa": (3, 2800, 1400)}
    out = None
    for name, (e, c, m) in parts.items():
        part = series(spark, *[(10 * i, e, c, m) for i in range(10)], strategy=name)
        out = part if out is None else out.unionAll(part)
    return out


def test_compare(spark):
    found = [(r["strategy"], round(r["simulated_cost_usd"], 6)) for r in ops.compare_strategies(three(spark)).collect()]
    assert found == [("dra", 0.000665), ("keda", 0.002394), ("hpa", 0.003724)]


def test_winners(spark):
    found = {r["metric"]: (r["winner"], r["label"]) for r in ops.metric_winners(ops.cost_summary(three(spark))).collect()}
    assert found == {
        "peak_executor_count": ("dra", "Dynamic Alloc"),
        "simulated_cost_usd": ("dra", "Dynamic Alloc"),
        "avg_cpu_utilisation_pct": ("hpa", "HPA"),
    }


def test_winner_ties_follow_the_fixed_order(spark):
    both = series(spark, (0, 1, 100, 100), strategy="dra").unionAll(series(spark, (0, 1, 100, 100.0001), strategy="hpa"))
    found = {r["metric"]: r["winner"] for r in ops.metric_winners(ops.cost_summary(both)).collect()}
    assert found["peak_executor_count"] == "hpa"
    assert found["simulated_cost_usd"] == "hpa"


def test_superlatives(spark):
    row = ops.run_superlatives(ops.cost_summary(three(spark))).collect()[0]
    assert tuple(row) == ("r", 3, "dra", "dra", "dra", "hpa")
    assert ops.run_superlatives(ops.cost_summary(series(spark, (0, 1, 1, 1)))).count() == 0


def test_dead_metrics(spark):
    df = series(spark, (0, 1, 0, 5), (10, 1, 0, 0), run="dead").unionAll(series(spark, (0, 1, 0, 0), (10, 1, 3, 4), run="live"))
    assert {r["run_id"]: r["warning"] for r in ops.dead_metrics(df).collect()} == {"dead": True, "live": False}


def test_labels(spark):
    df = spark.createDataFrame([("dra",), ("dynamic",), ("keda",), ("other",)], "s string")
    assert [r[0] for r in df.select(strategy_label(F.col("s"))).collect()] == ["Dynamic Alloc", "Dynamic Alloc", "KEDA", "other"]


def walk(points):
    """Latencies by walking the seconds in order."""
    by_second = {}
    for t, executors in points:
        by_second[t] = max(by_second.get(t, 0), executors)
    ordered = sorted(by_second.items())
    up = down = None
    start = next(((t, e) for t, e in ordered if e > 0), None)
    if start:
        up = next((float(t - start[0]) for t, e in ordered if t > start[0] and e > start[1]), None)
    peak = max(e for _, e in ordered)
    peak_at = max(t for t, e in ordered if e == peak)
    down = next((float(t - peak_at) for t, e in ordered if t > peak_at), None)
    return up, down


def test_latencies_equal_a_sequential_walk(spark):
    rng = random.Random(17)
    data = {}
    for i in range(150):
        length = rng.randint(1, 30)
        values = rng.choice([[0], [0, 1], [1], [0, 1, 2, 3], [2, 3], [0, 0, 0, 5]])
        data[f"run{i}"] = [(rng.randint(0, 60), rng.choice(values)) for _ in range(length)]
    rows = [(run, "keda", t, e, 1.0, 1.0) for run, points in data.items() for t, e in points]
    found = {
        r["run_id"]: (r["scale_up_latency_seconds"], r["scale_down_time_seconds"])
        for r in ops.scaling_times(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    assert found == {run: walk(points) for run, points in data.items()}


@pytest.mark.parametrize("width", [1, 4, 7, 25])
def test_scaling_is_the_same_in_any_slices(spark, width):
    rng = random.Random(width)
    data = {f"run{i}": [(rng.randint(-20, 60), rng.choice([0, 0, 1, 1, 2, 5])) for _ in range(rng.randint(1, 30))] for i in range(60)}
    rows = [(run, "keda", t, e, 1.0, 1.0) for run, points in data.items() for t, e in points]
    samples = spark.createDataFrame(rows, SCHEMA)
    parts = ops.scaling_parts(samples, width)
    halves = ops.merged_parts(parts.withColumn("half", F.floor(F.col("slice") / 3)), [*ops.SERIES, "half"])
    for found in (ops.scaling_times(samples, width), ops.scaling_of(ops.merged_parts(halves))):
        times = {r["run_id"]: (r["scale_up_latency_seconds"], r["scale_down_time_seconds"]) for r in found.collect()}
        assert times == {run: walk(points) for run, points in data.items()}


def test_no_window_over_a_whole_series(spark):
    plan = ops.scaling_times(series(spark, (0, 1, 1, 1)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("slice#" in line for line in windows)


def test_scaling_of_unknown_counts(spark):
    rows = [("r", "keda", 0, None, 1.0, 1.0), ("r", "keda", 10, 1, 1.0, 1.0), ("r", "keda", 20, 2, 1.0, 1.0), ("r", "keda", 30, None, 1.0, 1.0)]
    for width in (5, 1000):
        found = ops.scaling_times(spark.createDataFrame([*rows, ("r", "hpa", 5, None, 1.0, 1.0)], SCHEMA), width)
        assert {tuple(r) for r in found.collect()} == {("r", "keda", 10.0, 10.0), ("r", "hpa", None, None)}


def test_a_hot_series_is_folded_before_the_window(spark):
    """A third of a million samples of one series in five seconds, beside small series."""
    hot = spark.range(300_000).selectExpr(
        "'r' AS run_id", "'dra' AS strategy", "id % 5 AS timestamp", "cast(if(id % 5 = 3, 2, 1) as int) AS executor_count",
        "100.0D AS cpu_millicores", "64.0D AS memory_mib",
    )
    both = hot.unionAll(series(spark, (0, 1, 1, 1), (7, 2, 1, 1)))
    found = {r["strategy"]: r for r in ops.cost_summary(both).collect()}
    assert found["dra"]["duration_seconds"] == 3_000_000
    assert (found["dra"]["scale_up_latency_seconds"], found["dra"]["scale_down_time_seconds"]) == (3.0, 1.0)
    assert found["keda"]["scale_up_latency_seconds"] == 7.0
    folded = ops.scaling_times(both)._jdf.queryExecution().optimizedPlan().toString()
    assert folded.index("Window") < folded.index("Aggregate [run_id", folded.index("Window"))

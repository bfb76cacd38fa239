import random

import pytest

from ledgerline.operators import quality as ops
from ledgerline.schemas import SAMPLE_COLUMNS, text_schema

SERIES = "run_id string, strategy string, timestamp bigint, executor_count int, cpu_millicores double, memory_mib double"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), text_schema(["strategy", "timestamp", "executor_count", "cpu_millicores", "memory_mib"]))


GOOD = ("keda", "0", "2", "1800.0", "900.0")


@pytest.mark.parametrize("strategy", ["dra", "dynamic", "keda", "hpa"])
def test_valid_row(spark, strategy):
    good, rejects = ops.split_samples(raw(spark, (strategy, *GOOD[1:])), "full")
    assert rejects.count() == 0
    assert tuple(good.collect()[0])[2:] == (2, 1800.0, 900.0)


@pytest.mark.parametrize(
    "row, reason",
    [
        (("yarn", "0", "2", "1", "1"), "unknown strategy"),
        ((" Dynamic ", "0", "2", "1", "1"), "unknown strategy"),
        (("keda", "0", "2", "-1.0", "1"), "negative cpu_millicores"),
        (("keda", "0", "2", "1", "-0.5"), "negative memory_mib"),
        (("keda", "0", "99", "1", "1"), "executor_count out of range"),
        (("keda", "0", "-1", "1", "1"), "executor_count out of range"),
        (("keda", "0", "2.0", "1", "1"), "non-numeric executor_count"),
        (("keda", "0", "2", "warning-text", "1"), "non-numeric cpu_millicores"),
        (("keda", "0", "2", "nan", "1"), "non-numeric cpu_millicores"),
        (("keda", "0", "2", "1", "Infinity"), "non-numeric memory_mib"),
        (("keda", "0", "2", "1", "1f"), "non-numeric memory_mib"),
        (("keda", "0", "2", "1", None), "non-numeric memory_mib"),
        (("keda", "soon", "2", "1", "1"), "non-numeric timestamp"),
        ((None, "0", "2", "1", "1"), "missing strategy"),
    ],
)
def test_rejects_name_the_reason(spark, row, reason):
    good, rejects = ops.split_samples(raw(spark, row, GOOD), "full")
    assert good.count() == 1
    found = rejects.collect()
    assert len(found) == 1
    assert found[0]["reasons"] == reason
    assert tuple(found[0])[:5] == row


def test_all_reasons_are_listed(spark):
    _, rejects = ops.split_samples(raw(spark, ("yarn", "x", "1.5", "-1", "")), "full")
    assert rejects.collect()[0]["reasons"] == (
        "non-numeric timestamp; non-numeric executor_count; non-numeric memory_mib; unknown strategy; negative cpu_millicores"
    )


def test_loading_cleans_names_and_allows_any_range(spark):
    good, rejects = ops.split_samples(
        raw(spark, (" Dynamic ", " 5 ", "+99", "-1", "1e3"), ("YARN", "0", "1", ".5", "5."), ("keda", "0", "1.0", "1", "1"))
    )
    assert [tuple(r) for r in good.orderBy("strategy").collect()] == [
        ("dra", 5, 99, -1.0, 1000.0), ("yarn", 0, 1, 0.5, 5.0)
    ]
    assert rejects.count() == 1


def test_missing_column(spark):
    df = raw(spark, GOOD).drop("cpu_millicores")
    with pytest.raises(ValueError, match="missing required columns.*cpu_millicores"):
        ops.split_samples(df)


def test_reading_warnings(spark):
    df = raw(spark, GOOD, ("keda", "0", "1.5", "abc", "7"), ("keda", "0", "3", None, "-7"))
    assert {tuple(r) for r in ops.reading_warnings(df).collect()} == {
        ("executor_count", 1), ("cpu_millicores", 3), ("memory_mib", 2)
    }


def test_complete_runs(spark):
    columns = ["file", *SAMPLE_COLUMNS]

    def rows(file, *strategies, cpu="1"):
        return [(file, s, "0", "1", cpu, "1") for s in strategies]

    df = spark.createDataFrame(
        rows("20260101-120000-top_games.csv", "dra", "keda", "hpa")
        + rows("20260102-120000-steam_heavy.csv", "Dynamic", "keda", "HPA")
        + rows("20260103-120000-sentiment.csv", "dra", "keda")
        + rows("20260104-120000-sentiment.csv", "dra", "keda", "hpa", cpu="x"),
        text_schema(columns),
    )
    found = {r["run_id"]: (r["mode"], r["complete"]) for r in ops.complete_runs(df).collect()}
    assert found == {
        "20260101-120000": ("top_games", True), "20260102-120000": ("steam_heavy", True),
        "20260103-120000": ("sentiment", False), "20260104-120000": ("sentiment", False),
    }
    assert [r["run_id"] for r in ops.newest_complete_run(df).collect()] == ["20260102-120000"]


def shape(*executors, gap=10, cpu=1000.0, memory=500.0):
    return [(gap * i, e, cpu, memory) for i, e in enumerate(executors)]


PASSING = shape(*[1, 1], *[3] * 26, *[1] * 12)


def verdicts(spark, **by_strategy):
    rows = [("r", s, t, e, c, m) for s, points in by_strategy.items() for t, e, c, m in points]
    return {(r["strategy"], r["check"]): (r["passed"], r["observed"], r["bound"]) for r in ops.run_checks(spark.createDataFrame(rows, SERIES)).collect()}


def test_passing_run(spark):
    found = verdicts(spark, dra=PASSING, keda=PASSING, hpa=PASSING)
    failed = {key for key, value in found.items() if value[0] is False}
    skipped = {key for key, value in found.items() if value[0] is None}
    assert (failed, skipped) == (set(), {(None, "full_scale_costs_more")})
    assert len(found) == 3 * 11 + 2


def test_failing_checks(spark):
    found = verdicts(
        spark,
        dra=shape(*[1] * 4, 4, *[0] * 10, *[4] * 14, gap=25),
        keda=shape(*[1] * 5, *[2] * 35, cpu=-1.0),
        hpa=shape(*[1] * 40),
    )
    passed = {key: value[0] for key, value in found.items()}
    assert passed[("dra", "min_samples")] is False
    assert found[("dra", "sample_gap")] == (False, 25.0, "8 to 15")
    assert passed[("dra", "executor_cap")] is False
    assert found[("dra", "executor_floor")] == (False, 10.0, "0")
    assert found[("dra", "scale_up_delay")] == (False, 4.0, "<= 3")
    assert found[("dra", "scales_down")] == (False, 4.0, "< 4")
    assert found[("keda", "scale_up_delay")] == (False, 5.0, "<= 4")
    assert passed[("keda", "cpu_not_negative")] is False
    assert passed[("keda", "scales_down")] is False
    assert passed[("hpa", "scales_up")] is False
    assert passed[("hpa", "scale_up_delay")] is None
    assert passed[(None, "strategies_present")] is True


def test_idle_tail_compares_with_all_for_dra_and_with_the_rest_otherwise(spark):
    late_peak = shape(*[1] * 20, 3, *[1] * 11)
    found = verdicts(spark, dra=late_peak, keda=late_peak)
    assert found[("dra", "scales_down")][0] is True
    assert found[("keda", "scales_down")][0] is False
    assert found[(None, "strategies_present")][0] is False


def test_short_series_are_skipped(spark):
    found = verdicts(spark, keda=shape(*[0, 2] * 6), dra=shape(1))
    assert found[("keda", "executor_floor")][0] is None
    assert found[("keda", "scales_down")][0] is None
    assert found[("dra", "sample_gap")][0] is None


def test_full_scale_must_cost_more(spark):
    cheap = shape(*[1, 3] * 20, cpu=100.0, memory=1.0)
    dear = shape(*[1] * 40, cpu=900.0, memory=1.0)
    assert verdicts(spark, dra=dear, keda=cheap)[(None, "full_scale_costs_more")][0] is False
    assert verdicts(spark, dra=cheap, keda=[(t, 1, 50.0, 1.0) for t, *_ in cheap])[(None, "full_scale_costs_more")][0] is True


def test_equal_seconds_count_as_samples(spark):
    rows = [(10 * (i // 2), 1, 1.0, 1.0) for i in range(30)]
    found = verdicts(spark, keda=rows)
    assert found[("keda", "min_samples")][:2] == (True, 30.0)
    assert found[("keda", "sample_gap")][1] == 5.0


def facts(points):
    """Order facts of a series by walking its samples in order of time and executors."""
    ordered = sorted(points)
    head, tail, active = ordered[:11], ordered[-12:], ordered[:-12]
    return (
        (head[-1][0] - head[0][0]) / (len(head) - 1) if len(head) > 1 else None,
        next((i for i, (_, e) in enumerate(ordered) if e > 1), None),
        sum(e < 1 for _, e in active),
        min(e for _, e in tail),
        max((e for _, e in active), default=None),
    )


@pytest.mark.parametrize("width", [1, 9, 50, 86_400])
def test_order_facts_are_the_same_in_any_slices(spark, width):
    rng = random.Random(width)
    data = {f"run{i}": [(rng.randint(-30, 200), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.choice([1, 2, 11, 12, 13, 40]))] for i in range(60)}
    rows = [(run, "keda", t, e, 1.0, 1.0) for run, points in data.items() for t, e in points]
    samples = spark.createDataFrame(rows, "run_id string, strategy string, timestamp bigint, executor_count int, cpu_millicores double, memory_mib double")
    found = {r["run_id"]: tuple(r)[2:] for r in ops._order_facts(samples, width).collect()}
    assert found == {run: facts(points) for run, points in data.items()}
    plan = ops._order_facts(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert all("slice#" in line for line in plan.splitlines() if "Window [" in line)

import random

import pytest

from ledgerline.operators import series as ops

SCHEMA = "metric string, pod string, container string, area string, ts bigint, value double"


def metric(spark, name, *rows, container="spark-worker", area="heap"):
    return spark.createDataFrame([(name, pod, container, area, ts, float(v)) for pod, ts, v in rows], SCHEMA)


def test_counter_with_a_restart(spark):
    df = metric(spark, ops.CPU_COUNTER, ("p1", 0, 0), ("p1", 10, 5), ("p1", 20, 2), ("p1", 30, 4))
    found = ops.counter_rate(df).orderBy("ts").collect()
    assert [r["increase"] for r in found] == [0.0, 5.0, 2.0, 2.0]
    assert [r["rate"] for r in found] == [None, 0.5, 0.35, 0.3]


def test_steady_counter(spark):
    df = metric(spark, ops.CPU_COUNTER, *[("p", 10 * i, 5 * i) for i in range(20)])
    assert {r["rate"] for r in ops.counter_rate(df).collect()} == {None, 0.5}
    assert {r["rate"] for r in ops.counter_rate(df, 30).collect()} == {None, 0.5}


def test_window_forgets_what_is_older(spark):
    df = metric(spark, ops.CPU_COUNTER, ("p", 0, 0), ("p", 10, 100), ("p", 70, 106), ("p", 80, 107))
    assert [r["rate"] for r in ops.counter_rate(df).orderBy("ts").collect()] == [None, 10.0, 0.1, 0.1]


def shown(readings, lookback, step=10):
    """Per step of the grid the newest reading of each pod, by looking back from every step."""
    out = {}
    for t in range(-step, max(ts for _, ts, _ in readings) // step * step + lookback + 2 * step, step):
        for pod in {p for p, _, _ in readings}:
            seen = [(ts, v) for p, ts, v in readings if p == pod and t - lookback < ts <= t and v is not None]
            if seen:
                out[t, pod] = max(seen)[1]
    return out


@pytest.mark.parametrize("lookback", [7, 10, 60, 300])
def test_instant_values_of_irregular_scrapes(spark, lookback):
    rng = random.Random(lookback)
    readings = sorted({(p, t): None if rng.random() < 0.1 else float(t) for p in "abc" for t in rng.sample(range(500), 40)}.items())
    readings = [(p, t, v) for (p, t), v in readings]
    df = spark.createDataFrame(readings, "pod string, ts bigint, value double")
    found = ops.instant_values(df, ["pod"], "value", lookback).collect()
    assert {(r["step"], r["pod"]): r["value"] for r in found} == shown(readings, lookback)
    assert len(found) == len(shown(readings, lookback))


def test_steady_pods_scraped_at_odd_times(spark):
    """Two pods of 500 m, scraped every 15 seconds and not together: 1000 m from the second rate on."""
    rows = [(f"spark-worker-keda-{p}", t, t * 0.5) for p in (1, 2) for t in range(3 * p, 120, 15)]
    found = {r["step"]: (r["cpu_millicores"], r["series"]) for r in ops.cpu_millicores(ops.counter_rate(metric(spark, ops.CPU_COUNTER, *rows))).collect()}
    assert {step: found[step] for step in range(30, 160, 10)} == {step: (1000.0, 2) for step in range(30, 160, 10)}
    assert found[20] == (500.0, 1) and max(found) < 120 + 60


def test_memory_over_time_forgets_dead_pods(spark):
    mib = 1048576
    rows = [("spark-worker-hpa-1", 0, 9 * mib), ("spark-worker-hpa-1", 10, 2 * mib), ("spark-worker-hpa-2", 5, 3 * mib), ("spark-worker-hpa-2", 1000, mib)]
    found = {r["step"]: (r["memory_mib"], r["series"]) for r in ops.memory_mib(metric(spark, ops.WORKING_SET, *rows)).collect()}
    assert (found[0], found[10], found[300], found[1000]) == ((9.0, 1), (5.0, 2), (5.0, 2), (1.0, 1))
    assert 310 not in found and 1300 not in found


def test_heap_by_strategy_averages_the_pods_alive(spark):
    pods = {"spark-dynamic-1": (0, 50), "spark-dynamic-2": (7, 100)}
    heap = metric(spark, ops.HEAP_USED, *[(p, t, v) for p, (t, v) in pods.items()]).unionAll(metric(spark, ops.HEAP_MAX, *[(p, t, 200) for p, (t, _) in pods.items()]))
    found = {r["step"]: r["heap_pct"] for r in ops.heap_pct_by_strategy(heap).collect()}
    assert (found[0], found[10], found[290], found[300]) == (25.0, 37.5, 37.5, 50.0)


def test_heap(spark):
    heap = metric(spark, ops.HEAP_USED, ("a", 0, 50), ("a", 10, 100), ("b", 0, 20)).unionAll(
        metric(spark, ops.HEAP_MAX, ("a", 0, 200), ("a", 10, 200), ("b", 0, 0))
    ).unionAll(metric(spark, ops.HEAP_USED, ("a", 0, 9999), area="nonheap"))
    assert {tuple(r) for r in ops.heap_pct(heap).collect()} == {("a", 37.5), ("b", None)}
    assert {tuple(r) for r in ops.heap_bytes(heap).collect()} == {("a", 0, 50.0), ("a", 10, 100.0), ("b", 0, 20.0)}


def test_liveness(spark):
    df = metric(spark, ops.UP, *[("a", t, v) for t, v in [(0, 1), (1, 1), (2, 0), (3, 0), (4, 1)]], ("b", 0, 1), ("b", 2, 1))
    assert {tuple(r) for r in ops.executor_lifecycle(df).collect()} == {
        ("a", 1, 0, 1, 2), ("a", 0, 2, 3, 2), ("a", 1, 4, 4, 1), ("b", 1, 0, 2, 2)
    }


def test_live_pods_scraped_one_after_the_other(spark):
    rows = [(f"spark-worker-keda-{p}", t + p, 1) for p in range(3) for t in range(0, 100, 10)] + [("spark-dynamic-9", 0, 1), ("spark-dynamic-9", 30, 0)]
    found = {(r["strategy"], r["step"]): r["live"] for r in ops.live_count(metric(spark, ops.UP, *rows), lookback=20).collect()}
    assert [found["keda", t] for t in range(0, 110, 10)] == [1] + [3] * 10
    assert (found["dra", 0], found["dra", 10], found["dra", 30]) == (1, 1, 0) and ("dra", 20) not in found


def test_label_filters(spark):
    df = metric(spark, "m", ("spark-worker-keda-1", 0, 1), ("a.b", 0, 1), ("axb", 0, 1)).unionAll(
        metric(spark, "m", ("pause", 0, 1), container="POD")
    ).unionAll(metric(spark, "m", ("cgroup", 0, 1), container="", area="nonheap"))

    def pods(**labels):
        return {r["pod"] for r in ops.select_series(df, "m", **labels).collect()}

    assert pods(pods=["a.b"]) == {"a.b"}
    assert pods(pods=spark.createDataFrame([("axb",), ("axb",)], "pod string")) == {"axb"}
    assert pods(pod_prefix="spark-worker-keda") == {"spark-worker-keda-1"}
    assert pods(pod_prefix="a.") == {"a.b"}
    assert pods(real_containers=True) == {"spark-worker-keda-1", "a.b", "axb"}
    assert pods(area="nonheap") == {"cgroup"}
    assert ops.series_exists(df, "m", pod_prefix="a") is True
    assert ops.series_exists(df, "other") is False


def test_breaches(spark):
    values = [50, 66, 70, 65, 80, None, 90]
    readings = spark.createDataFrame(
        [("keda", "heap_pct", 10 * i, None if v is None else float(v)) for i, v in enumerate(values)]
        + [("dra", "heap_pct", 0, 99.0), ("hpa", "cpu_millicores", 0, 700.0)],
        "strategy string, signal string, step bigint, value double",
    )
    found = ops.threshold_breaches(readings, ops.thresholds(spark)).orderBy("breach_start").collect()
    assert [tuple(r) for r in found] == [
        ("keda", "heap_pct", 65.0, 10, 20, 2, 70.0),
        ("keda", "heap_pct", 65.0, 40, 40, 1, 80.0),
        ("keda", "heap_pct", 65.0, 60, 60, 1, 90.0),
    ]


def test_autoscaler_readings(spark):
    pods = ("spark-worker-hpa-1", "spark-worker-hpa-2")
    heap = metric(spark, ops.HEAP_USED, *[(p, 0, v) for p, v in zip(pods, (60, 80))]).unionAll(
        metric(spark, ops.HEAP_MAX, *[(p, 0, 100) for p in pods])
    )
    cpu = metric(spark, ops.CPU_COUNTER, *[(p, t, t * r) for p, r in zip(pods, (0.5, 0.25)) for t in (0, 5)])
    rows = ops.autoscaler_readings(heap.unionAll(cpu)).collect()
    found = {(r["strategy"], r["signal"]): r["value"] for r in rows}
    assert {r["step"] for r in rows if r["signal"] == "cpu_pct"} == set(range(10, 65, 10))
    assert found == {
        ("hpa", "heap_pct"): 70.0, ("hpa", "cpu_pct"): pytest.approx(37.5), ("hpa", "cpu_millicores"): pytest.approx(375.0)
    }


@pytest.mark.parametrize("slice_seconds", [20, 70, 86_400])
def test_breaches_over_slices(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    values = [rng.choice([50.0, 66.0, 80.0, 90.0, None]) if i % 40 > 25 else 99.0 for i in range(300)]
    readings = spark.createDataFrame([("keda", "heap_pct", 10 * i + (500 if i > 200 else 0), v) for i, v in enumerate(values)], "strategy string, signal string, step bigint, value double")
    wanted, open_span = [], None
    for i, v in enumerate([*values, None]):
        step = 10 * i + (500 if i > 200 else 0)
        if v is not None and v > 65:
            open_span = open_span or [step, step, 0, 0.0]
            open_span = [open_span[0], step, open_span[2] + 1, max(open_span[3], v)]
        elif open_span:
            wanted.append(tuple(open_span))
            open_span = None
    found = ops.threshold_breaches(readings, ops.thresholds(spark), slice_seconds).collect()
    assert sorted((r["breach_start"], r["breach_end"], r["readings"], r["peak"]) for r in found) == wanted


def test_extrapolated_rate_by_hand(spark):
    steady = metric(spark, ops.CPU_COUNTER, *[("p", 5 + 10 * i, 100 + 5 * i) for i in range(10)])
    found = {r["step"]: (r["samples"], r["rate"]) for r in ops.extrapolated_rate(steady).collect()}
    assert found[60] == (6, pytest.approx(0.5)) and found[10] == (1, None)
    assert found[30] == (3, pytest.approx(10 * (20 + 5 + 5) / 20 / 60))  # no earlier sample within 1.1 gaps of the edge
    assert found[120] == (4, pytest.approx(15 * (30 + 5 + 5) / 30 / 60))
    young = metric(spark, ops.CPU_COUNTER, ("p", 35, 1), ("p", 45, 21))
    rates = {r["step"]: r["rate"] for r in ops.extrapolated_rate(young).collect()}
    assert rates[50] == pytest.approx(20 * (10 + 0.5 + 5) / 10 / 60)  # back to where the counter was 0
    restart = metric(spark, ops.CPU_COUNTER, ("p", 10, 50), ("p", 30, 4), ("p", 50, 6))
    assert {r["step"]: (r["increase"], r["rate"]) for r in ops.extrapolated_rate(restart).collect()}[60] == (6.0, pytest.approx(6 * (40 + 10 + 10) / 40 / 60))
    flat = metric(spark, ops.CPU_COUNTER, ("p", 10, 50), ("p", 30, 50))
    assert {r["step"]: r["rate"] for r in ops.extrapolated_rate(flat).collect()}[30] == 0.0


def ragged(spark, seed):
    """Scrapes with bursts, long silences, restarts and times before 1970."""
    rng = random.Random(seed)
    rows = []
    for pod in ("a", "b", "c"):
        ts = -400
        for _ in range(80):
            ts += rng.choice([1, 5, 10, 15, 60, 300, 2000])
            rows.append((pod, ts, rng.choice([0, 1, 1, 2, 8])))
    return metric(spark, ops.CPU_COUNTER, *rows)


@pytest.mark.parametrize("slice_seconds", [7, 60, 450])
def test_slices_of_time_do_not_show(spark, slice_seconds):
    counter = ragged(spark, slice_seconds)
    seconds = counter.select("pod", "ts", "value")
    for job in (
        lambda width: ops.counter_rate(counter, 60, width),
        lambda width: ops.extrapolated_rate(counter, 90, 10, width),
        lambda width: ops.instant_values(seconds, ["pod"], "value", 45, 10, width),
        lambda width: ops.executor_lifecycle(counter, width),
    ):
        narrow, whole = [sorted(map(tuple, job(width).collect()), key=str) for width in (slice_seconds, 1 << 40)]
        assert narrow == whole and len(whole) > 20


def test_no_window_is_wider_than_a_slice(spark):
    counter = ragged(spark, 1)
    for job in (ops.counter_rate(counter), ops.extrapolated_rate(counter), ops.executor_lifecycle(counter), ops.instant_values(counter, ["pod"], "value", 60)):
        plan = job._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # besides slices, only one or two rows a slice are put in order
        assert windows and all("slice#" in line or "span_start#" in line for line in windows)

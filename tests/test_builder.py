"""Samples built from metrics and dumps, on small cases worked out by hand."""

from ledgerline.operators import series
from ledgerline.operators.builder import metrics_to_samples
from ledgerline.operators.samples import cost_summary

METRICS = "metric string, pod string, container string, area string, ts bigint, value double"
DUMP = "strategy string, timestamp bigint, cpu_millicores bigint, memory_mib bigint"


def built(spark, rows, dump=()):
    metrics = spark.createDataFrame([(m, p, "c", "heap", t, float(v)) for m, p, t, v in rows], METRICS)
    return metrics_to_samples(metrics, spark.createDataFrame(list(dump), DUMP), "r")


def shown(df, until=40):
    keys = ("strategy", "timestamp", "executor_count", "cpu_millicores", "memory_mib")
    return sorted(tuple(r[k] for k in keys) for r in df.collect() if r["timestamp"] <= until)


POD = "spark-worker-keda-1"
UP = [(series.UP, POD, t, int(t >= 20)) for t in range(0, 50, 10)]
CPU = [(series.CPU_COUNTER, POD, t, 0.25 * t) for t in range(0, 50, 10)]
MEMORY = [(series.WORKING_SET, POD, t, 64 * 1048576) for t in range(0, 50, 10)]


def test_metrics_from_the_first_running_pod_on(spark):
    assert shown(built(spark, UP + CPU + MEMORY)) == [("keda", t, 1, 250.0, 64.0) for t in (20, 30, 40)]


def test_dump_takes_over_for_both(spark):
    dump = [("keda", 30, 700, 99), ("keda", 40, None, 5)]
    assert shown(built(spark, UP + CPU, dump)) == [("keda", 20, 1, 0.0, 0.0), ("keda", 30, 1, 700.0, 99.0), ("keda", 40, 1, 0.0, 5.0)]


def test_dump_without_live_pods_has_no_executors(spark):
    found = shown(built(spark, UP[:3], [("keda", 9990, 7, 8), ("hpa", 0, 1, 1)]), 10_000)
    assert found[-1] == ("keda", 9990, 0, 7.0, 8.0) and {r[0] for r in found} == {"keda"}


def test_samples_can_be_costed(spark):
    row = cost_summary(built(spark, UP + CPU + MEMORY)).collect()[0]
    assert (row["run_id"], row["strategy"], row["peak_executor_count"]) == ("r", "keda", 1)


def test_nothing_reported(spark):
    assert built(spark, []).count() == 0

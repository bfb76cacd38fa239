"""The stream jobs give what the batch jobs give on the same files."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.frames import rounded
from ledgerline.operators.quality import split_samples
from ledgerline.operators.samples import cost_summary, minute_rollup, started_samples
from ledgerline.schemas import SAMPLE_COLUMNS
from ledgerline.sources.files import read_raw_samples
from ledgerline.sources.shared import shared_folder
from ledgerline.streaming import samples as ops

HEADER = ",".join(SAMPLE_COLUMNS) + "\n"


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(2)
    folder = tmp_path / "samples"
    folder.mkdir()
    for part in range(4):
        lines = [
            f"{rng.choice(['dra', 'keda', 'hpa', 'yarn'])},{rng.randint(0, 900)},{rng.choice(['0', '1', '3', '2.0', '99'])},"
            f"{rng.choice(['500', '-1', 'x', '1500'])},{rng.randint(0, 9) * 512}"
            for _ in range(60)
        ]
        (folder / f"part-{part}.csv").write_text(HEADER + "\n".join(lines) + "\n")
    return str(folder)


def batch(spark, folder):
    return read_raw_samples(spark, folder)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_ingest_equals_batch(spark, folder):
    good, rejects = ops.ingest_now(ops.stream_samples(spark, folder))
    batch_good, batch_rejects = split_samples(batch(spark, folder), "full")
    assert rows(good.select(batch_good.columns)) == rows(batch_good)
    assert rows(rejects.select(batch_rejects.columns)) == rows(batch_rejects)
    assert len(rows(good)) > 0 and len(rows(rejects)) > 0


def test_ingest_is_one_query_and_goes_on_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "growing"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "keda,10,1,100,1\nkeda,x,1,100,1\n")
    raw, out = ops.stream_samples(spark, str(folder)), shared_folder(spark, "growing")

    def step():
        ops.ingest(raw, out).awaitTermination()
        return tuple(df.count() for df in ops.ingested(raw, out))

    assert step() == (1, 1)
    assert step() == (1, 1)
    (folder / "b.csv").write_text(HEADER + "hpa,10,1,100,1\nyarn,1,1,100,1\n,1,1,1,1\n")
    assert step() == (2, 3)


def test_streamed_samples_enter_a_cost_summary(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    for run in ("20260101-120000", "20260102-120000"):
        (folder / f"{run}-steam_heavy.csv").write_text(HEADER + "keda,10,1,100,1\nkeda,20,2,1500,1\n")
    good, _ = ops.ingest_now(ops.stream_samples(spark, str(folder)))
    assert {(r["run_id"], r["mode"]) for r in good.collect()} == {("20260101-120000", "steam_heavy"), ("20260102-120000", "steam_heavy")}
    assert {(r["run_id"], r["scale_up_latency_seconds"]) for r in cost_summary(good).collect()} == {("20260101-120000", 10.0), ("20260102-120000", 10.0)}


def test_rollup_equals_batch(spark, folder):
    good, _ = split_samples(ops.stream_samples(spark, folder).withColumn("file", F.lit("f")), "full")
    batch_good, _ = split_samples(batch(spark, folder), "full")
    found = rows(rounded(ops.rollup_now(good), 9))
    assert found == rows(rounded(minute_rollup(batch_good), 9))
    assert len(found) > 10


def test_late_samples_count_in_the_kept_rollup(spark, tmp_path):
    folder = tmp_path / "later"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "keda,10,1,100,1\nkeda,500,1,100,1\n")
    good, _ = split_samples(ops.stream_samples(spark, str(folder)))
    out = shared_folder(spark, "later")

    def step():
        ops.rollup(good, out).awaitTermination()
        return {(r["minute_start"], r["sample_count"], r["peak_executor_count"]) for r in ops.rolled_up(good, out).collect()}

    assert step() == {(0, 1, 1), (480, 1, 1)}
    (folder / "b.csv").write_text(HEADER + "keda,20,3,100,1\n")
    assert step() == {(0, 2, 3), (480, 1, 1)}
    assert step() == {(0, 2, 3), (480, 1, 1)}


def test_late_samples_are_dropped_behind_a_watermark(spark, tmp_path):
    folder = tmp_path / "late"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "keda,10,1,100,1\nkeda,200,1,100,1\n")
    good, _ = split_samples(ops.stream_samples(spark, str(folder)))
    out = shared_folder(spark, "late")

    def step():
        ops.write_stream(minute_rollup(good), f"{out}/minutes", f"{out}/checkpoint").awaitTermination()
        return {(r["minute_start"], r["sample_count"]) for r in spark.read.parquet(f"{out}/minutes").collect()}

    assert step() == {(0, 1)}
    (folder / "b.csv").write_text(HEADER + "keda,20,1,100,1\nkeda,190,1,100,1\nkeda,400,1,100,1\n")
    assert step() == {(0, 1), (180, 2)}


def test_no_rejects_is_an_empty_table(spark, tmp_path):
    folder = tmp_path / "clean"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "keda,10,1,100,1\n")
    good, rejects = ops.ingest_now(ops.stream_samples(spark, str(folder)))
    assert (good.count(), rejects.count()) == (1, 0)
    assert ops.rollup_now(split_samples(ops.stream_samples(spark, str(folder)))[0]).count() == 1


def test_nothing_arrived(spark, tmp_path):
    folder = tmp_path / "none"
    folder.mkdir()
    assert ops.rollup_now(split_samples(ops.stream_samples(spark, str(folder)))[0]).count() == 0


def test_header_must_match(spark, tmp_path):
    folder = tmp_path / "swapped"
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp,strategy,executor_count,cpu_millicores,memory_mib\n1,keda,1,1,1\n")
    with pytest.raises(Exception, match="header"):
        ops.ingest_now(ops.stream_samples(spark, str(folder)))


SAMPLE = "run_id string, strategy string, timestamp bigint, executor_count int, cpu_millicores double, memory_mib double"


class Arriving:
    """Samples (strategy, timestamp, executors) that arrive in steps, each a run of the stream from its checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.folder, self.options = spark, shared_folder(spark, "arriving"), options
        self.all = []

    def step(self, *rows):
        rows = [("r", s, t, e, 100.0, 64.0) for s, t, e in rows]
        self.all += rows
        self.spark.createDataFrame(rows, SAMPLE).write.mode("append").parquet(f"{self.folder}/samples")
        self.stream = self.spark.readStream.schema(SAMPLE).parquet(f"{self.folder}/samples")

    def gated(self):
        ops.write_stream(ops.started_stream(self.stream, **self.options), f"{self.folder}/out", f"{self.folder}/checkpoint").awaitTermination()
        return sorted((r["strategy"], r["timestamp"], r["executor_count"]) for r in self.spark.read.schema(SAMPLE).parquet(f"{self.folder}/out").collect())

    def ledger(self):
        for query in ops.close_minutes(self.stream, self.folder):
            query.awaitTermination()
        return ops.minute_ledger(self.stream, self.folder)


def test_gate_in_time_order_equals_batch_and_survives_restarts(spark):
    rng = random.Random(5)
    arriving = Arriving(spark)
    for start in (0, 300, 600):
        arriving.step(*[(rng.choice(["dra", "keda", "hpa", "idle"]), rng.randint(start, start + 299), 0) for _ in range(30)],
                      *[(s, rng.randint(start, start + 299), rng.choice([0, 0, 1])) for s in ("dra", "keda") for _ in range(8)],
                      *([("hpa", 750, 2)] if start == 600 else []))
        found = arriving.gated()
    batch = started_samples(spark.createDataFrame(arriving.all, SAMPLE))
    assert found == sorted((r["strategy"], r["timestamp"], r["executor_count"]) for r in batch.collect())
    assert {s for s, _, _ in found} == {"dra", "keda", "hpa"}


def test_gate_keeps_state_between_runs_and_forgets_idle_series(spark):
    arriving = Arriving(spark, idle_seconds=500)
    arriving.step(("keda", 5, 0), ("keda", 20, 1), ("keda", 10, 0), ("hpa", 30, 0))
    assert arriving.gated() == [("keda", 20, 1)]
    arriving.step(("keda", 40, 0), ("hpa", 40, 0))
    assert arriving.gated() == [("keda", 20, 1), ("keda", 40, 0)]
    arriving.step(("hpa", 50, 3), ("hpa", 2000, 0))
    kept = [("hpa", 50, 3), ("hpa", 2000, 0), ("keda", 20, 1), ("keda", 40, 0)]
    assert arriving.gated() == kept
    arriving.step(("keda", 2010, 0), ("hpa", 2010, 0))
    assert arriving.gated() == sorted([*kept, ("hpa", 2010, 0)])


def test_ledger_counts_late_samples(spark):
    arriving = Arriving(spark)

    def shown():
        rows = arriving.ledger().collect()
        assert sum(r["on_time"] + r["late"] for r in rows) == len(arriving.all)
        return {(r["strategy"], r["minute_start"]): (r["closed"], r["on_time"], r["late"], r["peak_executor_count"]) for r in rows}

    arriving.step(("keda", 10, 1), ("keda", 95, 2), ("keda", 200, 1))
    assert shown() == {("keda", 0): (True, 1, 0, 1), ("keda", 60): (True, 1, 0, 2), ("keda", 180): (False, 1, 0, 1)}
    arriving.step(("keda", 20, 9), ("keda", 175, 4), ("keda", 190, 3), ("hpa", 70, 1), ("keda", 400, 1))
    assert shown() == {
        ("keda", 0): (True, 1, 1, 1), ("keda", 60): (True, 1, 0, 2), ("keda", 120): (True, 1, 0, 4),
        ("keda", 180): (True, 2, 0, 3), ("keda", 360): (False, 1, 0, 1), ("hpa", 60): (True, 0, 1, None),
    }

"""The sample jobs on a stream: the batch functions and file sinks."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.quality import labelled_samples, unlabelled_samples, with_run
from ledgerline.operators.samples import INTERVAL_SECONDS, SERIES, merged_minutes, minute_parts, minute_rollup
from ledgerline.schemas import SAMPLE_COLUMNS, text_schema
from ledgerline.sources.shared import shared_folder


def stream_samples(spark: SparkSession, path: str, columns=None, **options) -> DataFrame:
    """Sample files as they arrive, as text, with the file and the run its name stands for, like the batch reader.

    A header that differs from the columns is an error.
    """
    reader = spark.readStream.schema(text_schema(columns or SAMPLE_COLUMNS)).option("header", True)
    return with_run(reader.option("enforceSchema", False).options(**options).csv(path))


def write_stream(df: DataFrame, path: str, checkpoint: str, every=None, partition_by=()):
    """Append to parquet, exactly once. Without ``every`` all present input is read, then it ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = df.writeStream.format("parquet").outputMode("append").trigger(**trigger)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()


def ingest(raw: DataFrame, folder: str, rules="full", every=None):
    """Validate the input once into a table that keeps good samples and rejects in separate partitions."""
    labelled = labelled_samples(raw, rules)
    return write_stream(labelled, f"{folder}/samples", f"{folder}/checkpoint", every, ["outcome"])


def ingested(raw: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) as written so far by an ingest of ``raw``."""
    table = raw.sparkSession.read.schema(labelled_samples(raw).schema).parquet(f"{folder}/samples")
    return unlabelled_samples(table)


def ingest_now(raw: DataFrame, rules="full") -> tuple[DataFrame, DataFrame]:
    """Run the ingest over all present input; (good, rejects) as written."""
    folder = shared_folder(raw.sparkSession, "ingest")
    ingest(raw, folder, rules).awaitTermination()
    return ingested(raw, folder)


def rollup(samples: DataFrame, folder: str, interval_seconds=INTERVAL_SECONDS, every=None):
    """Keep the minute rollup of a stream of samples in ``folder``: a table of parts per micro-batch.

    The parts add up, so every sample counts whenever it arrives, no minute waits for a watermark and the stream
    holds no state. A batch that is run again overwrites its own parts.
    """
    parts = f"{folder}/parts"

    def keep(batch, number):
        minute_parts(batch, interval_seconds).write.mode("overwrite").parquet(f"{parts}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = samples.writeStream.foreachBatch(keep).trigger(**trigger)
    return writer.option("checkpointLocation", f"{folder}/checkpoint").start()


def _kept_parts(samples: DataFrame, folder: str, interval_seconds) -> DataFrame:
    shape = minute_parts(samples, interval_seconds).schema
    parts = samples.sparkSession.read.schema(shape).option("pathGlobFilter", "*.parquet")
    return parts.option("recursiveFileLookup", True).parquet(folder)


def rolled_up(samples: DataFrame, folder: str, interval_seconds=INTERVAL_SECONDS) -> DataFrame:
    """The rollup of all samples that a ``rollup`` of ``samples`` has kept so far; equals the batch rollup of them."""
    return merged_minutes(_kept_parts(samples, folder, interval_seconds))


def rollup_now(samples: DataFrame, interval_seconds=INTERVAL_SECONDS) -> DataFrame:
    """Run the minute rollup over all present input."""
    folder = shared_folder(samples.sparkSession, "rollup")
    rollup(samples, folder, interval_seconds).awaitTermination()
    return rolled_up(samples, folder, interval_seconds)


def close_minutes(samples: DataFrame, folder: str, lateness_seconds=30, interval_seconds=INTERVAL_SECONDS, every=None):
    """Start the two queries whose tables ``minute_ledger`` reads: closed minutes and all samples.

    A minute closes when the watermark, the latest sample's time less ``lateness_seconds``, reaches its end. It is then
    appended once, and the state store forgets it; samples that come later are dropped by that query. The other one
    keeps parts of all samples, so what was dropped is known as the difference.
    """
    closing = minute_rollup(samples, interval_seconds, f"{lateness_seconds} seconds")
    return [
        write_stream(closing, f"{folder}/closed", f"{folder}/closed-checkpoint", every),
        rollup(samples, f"{folder}/all", interval_seconds, every),
    ]


def minute_ledger(samples: DataFrame, folder: str, lateness_seconds=30, interval_seconds=INTERVAL_SECONDS) -> DataFrame:
    """Every minute and strategy seen so far: closed or not, samples on time and late, and the rollup of those on time.

    On time and late together are all samples that arrived. A closed minute's figures do not change any more; those of
    an open minute, to which nothing can be late yet, are of the samples so far. A closed minute of late samples
    only has no figures. Both queries must have seen the same input.
    """
    keys = ["minute_start", "minute_end", "strategy"]
    parts = _kept_parts(samples, f"{folder}/all", interval_seconds)
    shape = minute_rollup(samples, interval_seconds).schema
    closed = samples.sparkSession.read.schema(shape).parquet(f"{folder}/closed")
    figures = [name for name in closed.columns if name not in keys]
    closed = closed.withColumnsRenamed({name: f"closed_{name}" for name in figures})
    watermark = parts.agg(F.max("last_timestamp") - lateness_seconds).scalar()
    seen = merged_minutes(parts).join(closed, keys, "left").withColumn("closed", F.col("minute_end") <= watermark)
    is_closed = F.col("closed")
    on_time = F.when(is_closed, F.coalesce("closed_sample_count", F.lit(0))).otherwise(F.col("sample_count"))
    return seen.select(
        *keys,
        "closed",
        on_time.alias("on_time"),
        (F.col("sample_count") - on_time).alias("late"),
        *[F.when(is_closed, F.col(f"closed_{n}")).otherwise(F.col(n)).alias(n) for n in figures if n != "sample_count"],
    )


def _earliest_running(rows: pd.DataFrame, start):
    running = rows.loc[rows["executor_count"] > 0, "timestamp"]
    found = [int(running.min())] if len(running) else []
    return min(found + ([] if start is None else [start]), default=None)


def started_stream(samples: DataFrame, lateness="30 seconds", idle_seconds=86_400) -> DataFrame:
    """The samples of a stream from the first second with running executors of each series on, as they arrive.

    The state of a (run, strategy) is that second and the latest one seen; a series that never ran has none, and a
    timer forgets a series ``idle_seconds`` of sample time after its latest sample. Within a micro-batch samples may come
    in any order. Over micro-batches in the order of time the result is that of the batch job; a running sample that
    comes after later ones opens the series from its own second on, but what was dropped before stays dropped. Samples
    further than ``lateness`` behind the latest one of earlier micro-batches are dropped. A task holds those samples of a series and micro-batch that come before the first running one.
    """
    columns = samples.columns

    def passed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, seen = state.get if state.exists else (None, None)
        waiting = []
        for rows in frames:
            seen = max([int(rows["timestamp"].max())] + ([] if seen is None else [seen]))
            start = _earliest_running(rows, start)
            open_ = rows["timestamp"] >= start if start is not None else pd.Series(False, index=rows.index)
            waiting.append(rows[~open_])
            if open_.any():
                yield rows.loc[open_, columns]
        if start is not None:
            for rows in waiting:
                if (rows["timestamp"] >= start).any():
                    yield rows.loc[rows["timestamp"] >= start, columns]
            state.update((start, seen))
            state.setTimeoutTimestamp(max((seen + idle_seconds) * 1000, state.getCurrentWatermarkMs() + 1000))

    stamped = samples.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", lateness)
    return stamped.groupBy(*SERIES).applyInPandasWithState(
        passed, samples.schema, "start long, seen long", "append", GroupStateTimeout.EventTimeTimeout
    )

"""Writing results."""

from pyspark.sql import DataFrame


def write_single(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for results of report size; the order of rows is kept."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Parquet in as many files as the result has partitions, for results that grow with the input."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_each(results: dict, base: str, write=write_single) -> None:
    """One folder per named result. Persist a shared input first: each write is a job of its own."""
    for name, df in results.items():
        write(df, f"{base.rstrip('/')}/{name}")

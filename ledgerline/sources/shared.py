"""The shared folder for checkpoints and intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for one run in the folder that the session names in spark.checkpoint.dir.

    Without that setting, the folder ``scratch`` of the warehouse, which a cluster shares as well. A warehouse on a
    machine's own disk, as it is unless set, will do for a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{base} is one machine's disk: set spark.checkpoint.dir or a shared spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: computed once, and safe from lost executors.

    Runs a job. The files stay, since the caller's result still reads them.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

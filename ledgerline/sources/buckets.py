"""Tables stored in buckets, so that joins and groupings by their key need no shuffle."""

import uuid

from pyspark.sql import DataFrame

from ledgerline.sources.shared import shared_folder


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``key``, sorted by it, in the shared folder; read again.

    Two such tables with the same number of buckets are joined bucket by bucket. A hot key is one bucket and cannot be
    split, so this layout suits keys without one. Rows are dealt to the buckets before they are written, one file each.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", shared_folder(spark, name)).saveAsTable(table)
    return spark.table(table)

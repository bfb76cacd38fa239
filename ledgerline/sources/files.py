"""Reading the input files.

Headed CSV is read by column name, so files may hold more columns or another order; everything
is text until a job types it. Parquet copies of the same tables are accepted as well.
"""

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.frames import require_columns
from ledgerline.functions.scalars import strategy_name
from ledgerline.operators.quality import labelled_samples, run_of_file, unlabelled_samples, with_run
from ledgerline.schemas import (
    GAME_COLUMNS,
    REVIEW_COLUMNS,
    SALE_COLUMNS,
    SAMPLE_COLUMNS,
    USER_COLUMNS,
    text_schema,
)
from ledgerline.sources.shared import written

SCRAPE_FILE = r"^([A-Za-z]+)-(\d+)\."


@dataclass(frozen=True)
class DataRoot:
    """Where a user's tables lie. ``fmt`` is csv or parquet; the path is any Spark can open."""

    path: str
    fmt: str = "csv"

    @staticmethod
    def from_env(fmt="csv"):
        return DataRoot(os.environ.get("DATA_PATH", "data"), fmt)

    def table(self, *parts):
        return "/".join([self.path.rstrip("/"), *parts]) + f".{self.fmt}"

    def output(self, *parts):
        return "/".join([self.path.rstrip("/"), "output", *parts])


def _headed(spark: SparkSession, root: DataRoot, parts, columns) -> DataFrame:
    path = root.table(*parts)
    if root.fmt == "csv":
        df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    else:
        df = spark.read.format(root.fmt).load(path)
    require_columns(df, columns, path)
    return df


def read_reviews(spark, root: DataRoot) -> DataFrame:
    return _headed(spark, root, ("games", "recommendations"), REVIEW_COLUMNS)


def read_games(spark, root: DataRoot) -> DataFrame:
    return _headed(spark, root, ("games", "games"), GAME_COLUMNS)


def read_users(spark, root: DataRoot) -> DataFrame:
    return _headed(spark, root, ("games", "users"), USER_COLUMNS)


def read_sales(spark, root: DataRoot) -> DataFrame:
    """16 fields without a header: short rows are filled with null, long rows lose the excess."""
    path = root.table("input", "land-data")
    if root.fmt == "csv":
        return spark.read.schema(text_schema(SALE_COLUMNS)).option("header", False).csv(path)
    df = spark.read.format(root.fmt).load(path)
    require_columns(df, SALE_COLUMNS, path)
    return df


def _placed():
    """Where a row stands: its file, the split of the file that it was read from, and a number that grows along the split."""
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ]


def _any_order(spark, path) -> DataFrame:
    """Sample files read by each file's own header: fields by place, named by joining the header row of the file.

    Looks at the lines first, for the number of fields of the widest header; then reads the files twice, once for the
    header rows. A file without the required columns is an error.
    """
    lines = spark.read.text(path)
    for name in SAMPLE_COLUMNS[:2]:
        lines = lines.filter(F.col("value").contains(name))
    most = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or len(SAMPLE_COLUMNS)
    names = [f"c{i}" for i in range(most)]
    rows = spark.read.schema(text_schema(names)).option("header", False).csv(path)
    cells = rows.select(F.array(*names).alias("cells"), *_placed(), F.col("_metadata.file_name").alias("file"))
    is_header = F.lit(True)
    for name in SAMPLE_COLUMNS[:2]:
        is_header &= F.coalesce(F.array_contains("cells", name), F.lit(False))
    headers = cells.filter(is_header).groupBy("path").agg(F.first("cells").alias("header"))
    joined = cells.withColumn("is_header", is_header).join(headers, "path", "left")

    def cell(name):
        place = F.array_position("header", name)
        missing = F.raise_error(F.concat(F.col("file"), F.lit(f" missing required columns: {name}"))).cast("string")
        return F.when(F.coalesce(place, F.lit(0)) == 0, missing).otherwise(F.get("cells", (place - 1).cast("int"))).alias(name)

    run_id, mode = run_of_file(F.col("file"))
    return (
        joined.select(*[cell(name) for name in SAMPLE_COLUMNS], "file", "path", "block", "seq", "is_header")
        .withColumn("run_id", F.when(run_id == "", F.col("file")).otherwise(run_id))
        .withColumn("mode", mode)
    )


def _raw_placed(spark, path, any_order) -> tuple[DataFrame, int]:
    """Sample rows as text with their places, and the number that the first of the rows has in its file."""
    if any_order:
        return _any_order(spark, path), 1
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    require_columns(df, SAMPLE_COLUMNS, path)
    run = with_run(df.select(*SAMPLE_COLUMNS), *_placed())
    return run.withColumn("is_header", F.lit(False)), 2


RAW_COLUMNS = [*SAMPLE_COLUMNS, "file", "run_id", "mode"]


def read_raw_samples(spark, path, any_order=False) -> DataFrame:
    """Sample files as text, with the file each row came from and the run its name stands for.

    The columns may be in any order, but in the same one in all files, unless ``any_order`` is set.
    """
    raw, _ = _raw_placed(spark, path, any_order)
    return raw.filter("NOT is_header").select(*RAW_COLUMNS)


def row_numbers(marked: DataFrame, placed: DataFrame, first: int) -> DataFrame:
    """``marked`` rows of ``placed`` with their row number in the file instead of block and seq.

    ``placed`` has every row that was read. Rows are counted per split of a file, and the counts of the splits before
    are added up, so that only two numbers a split meet in one place. ``first`` is the number of a file's first row.
    """
    blocks = placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", "first_seq", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    number = F.col("rows_before") + F.col("seq") - F.col("first_seq") + first
    return marked.join(starts, ["path", "block"]).withColumn("row", number).drop("block", "seq", "first_seq", "rows_before")


def read_samples(spark, path, strict=True, any_order=False, rules="load") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of sample files; rejects keep the text as it came, with the reasons, their file's ``path`` and
    their ``row`` in it.

    Rows are numbered as records: the header is row 1, and lines without any text do not count. The files are read and
    typed once, into a table in the shared folder; a file may have been read in several splits. Strict reading has no
    rejects: the job that meets a bad row stops and names the first bad file and row, the row and what is wrong. An
    input without rows is an error in strict mode, seen at once.
    """
    raw, first = _raw_placed(spark, path, any_order)
    table = written(labelled_samples(raw, rules), "samples")
    rows = table.filter("NOT is_header")
    if strict and rows.isEmpty():
        raise ValueError(f"No samples in {path}")
    good, bad = unlabelled_samples(rows)
    rejects = row_numbers(bad, table, first).select(*RAW_COLUMNS, "path", "row", "reasons")
    if not strict:
        return good.select(*RAW_COLUMNS), rejects
    found = rejects.orderBy("file", "row").limit(1).collect()
    if found:  # a filter, since a column that a job does not read is never computed; over all rows, as none may be good
        good = rows.filter(F.raise_error(F.lit(_complaint(found[0]))).cast("boolean"))
    return good.select(*RAW_COLUMNS), rejects.limit(0)


def _complaint(row) -> str:
    shown = {name: row[name] for name in SAMPLE_COLUMNS}
    return f"Invalid numeric data in {row['file']} at row {row['row']}: {shown}: {row['reasons']}"


def _of_scrape(df: DataFrame) -> DataFrame:
    """With the file name, and strategy and timestamp where it is <strategy>-<seconds>.<anything>."""
    name = F.col("_metadata.file_name")
    stamp = F.regexp_extract(name, SCRAPE_FILE, 2).try_cast("bigint")
    strategy = F.when(stamp.isNotNull(), strategy_name(F.regexp_extract(name, SCRAPE_FILE, 1)))
    return df.select(*df.columns, name.alias("scrape"), strategy.alias("strategy"), stamp.alias("timestamp"))


def read_lines(spark, path) -> DataFrame:
    """Usage dumps: one text file per scrape, one row per line: line, scrape, strategy, timestamp."""
    return _of_scrape(spark.read.text(path).withColumnRenamed("value", "line"))


def read_answers(spark, path) -> DataFrame:
    """Metric answers: one JSON document per file: answer, scrape, strategy, timestamp."""
    return _of_scrape(spark.read.text(path, wholetext=True).withColumnRenamed("value", "answer"))

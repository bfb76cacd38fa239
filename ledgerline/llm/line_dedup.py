"""Line dedup: passages of three consecutive lines that occur again are removed, DataFrame functions only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.texts import ID, KEY, TEXT, attach, keyed
from ledgerline.sources.shared import written

LINES = 3


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """One row per window with a line that is not blank: doc_id, key, start line, 128 bits of digest."""
    cut = F.transform(F.split(F.col(TEXT), "\n", -1), lambda line: F.trim(line, F.lit(" \t\r")))
    digests = docs.select(ID, KEY, cut.alias("cut")).select(
        ID,
        KEY,
        F.transform("cut", lambda line: F.xxhash64(line)).alias("first"),
        F.transform("cut", lambda line: F.xxhash64(F.lit(1), line)).alias("second"),
    )
    starts = F.when(F.size("first") >= lines, F.sequence(F.lit(0), F.size("first") - lines))

    def digest(name, start):
        return F.xxhash64(*[F.get(F.col(name), start + i) for i in range(lines)])

    window = F.transform(
        starts, lambda s: F.struct(s.alias("start"), digest("first", s).alias("d1"), digest("second", s).alias("d2"))
    )
    blank = F.xxhash64(*[F.xxhash64(F.lit(""))] * lines)
    # the outer form, since Spark would compute the array twice to filter out empty ones first
    return digests.select(ID, KEY, F.inline_outer(window)).where(F.col("d1") != blank)


def repeated_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, key and start line of every window whose lines occurred before, in keyed documents.

    The first occurrence is the one with the least (doc_id, key, start line), a null id first. Lines
    are compared without outer blanks, and windows of blank lines only are left alone. Windows are counted with map-side combining, so one that is
    in every document is a single row per task; only digests, never lines, are shuffled.
    """
    windows = _windows(docs, lines)
    place = F.struct(ID, KEY, "start")
    repeated = (
        windows.groupBy("d1", "d2")
        .agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("d1", "d2", "earliest")
    )
    # written, so that both sides of the join are plain shuffles and a hot window can be split
    repeated = written(repeated, "windows")
    return windows.join(repeated, ["d1", "d2"]).where(place > F.col("earliest")).select(ID, KEY, "start")


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with its repeated passages removed: every row and column, ``text`` replaced, and two more.

    A window is ``lines`` consecutive lines (cut at \\n). In the order of (doc_id, line), every occurrence
    after the first is removed, in the same document too; overlapping windows are merged, so a line goes
    once. ``n_lines`` counts the lines before, ``n_removed`` those removed (0 for most rows). Texts of fewer
    lines have no window and stay, empty text stays empty, and null text stays null with no lines. A
    document of which nothing is left has an empty text. Rows that agree in doc_id and text are one
    document: both keep or lose the same lines. Names of the two new columns replace columns of that name.
    """
    wide = docs.withColumn(KEY, F.xxhash64(F.coalesce(F.col(TEXT).cast("string"), F.lit(""))))
    starts = (
        repeated_windows(keyed(docs), lines)
        .groupBy(ID, KEY)
        .agg(F.collect_set("start").alias("_llm_starts"))
    )
    covered = F.array_distinct(
        F.flatten(F.transform("_llm_starts", lambda s: F.sequence(s, s + lines - 1)))
    )
    cut = F.split(F.col(TEXT), "\n", -1)
    positions = F.array_except(F.sequence(F.lit(0), F.size("_llm_cut") - 1), "_llm_covered")
    kept = F.array_join(F.transform(positions, lambda i: F.get(F.col("_llm_cut"), i)), "\n")
    return (
        attach(wide, starts)
        .withColumn("_llm_covered", covered)
        .withColumn("_llm_cut", cut)
        .withColumn("n_lines", F.when(F.col(TEXT).isNull(), 0).otherwise(F.size("_llm_cut")).cast("long"))
        .withColumn("n_removed", F.when(F.col("_llm_covered").isNull(), 0).otherwise(F.size("_llm_covered")).cast("long"))
        .withColumn(TEXT, F.when(F.col("_llm_covered").isNull(), F.col(TEXT)).otherwise(kept))
        .drop(KEY, "_llm_starts", "_llm_covered", "_llm_cut")
    )

"""Substring dedup: lines and paragraphs are hashed, and those of some length are kept at their earliest place only."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerline.llm.texts import ID, KEY, TEXT, attach, keyed, release_memory
from ledgerline.sources.shared import written

MIN_CHARS = 80
CHUNK = 20_000


def spans(text: str):
    """(start, end) of each line that is not blank, and of each paragraph of two or more such lines in a row."""
    at, first, last = 0, None, None
    for line in [*text.split("\n"), ""]:
        if line.strip():
            yield at, at + len(line)
            first, last = (at if first is None else first), at + len(line)
            several = first < at
        elif first is not None:
            if several:
                yield first, last
            first = None
        at += len(line) + 1


def units(text: str):
    """(start, end, chars, digest high, digest low) of each line and paragraph of a text.

    Offsets are code points of the text as given; ``chars`` is the length with each run of white space as one space,
    and the digest is of that in lower case, so a passage that was wrapped anew has the digest it had.
    """
    for start, end in spans(text):
        plain = " ".join(text[start:end].split())
        digest = xxhash.xxh3_128_intdigest(plain.lower().encode("utf-8", "surrogatepass"))
        yield start, end, len(plain), (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def unit_digests(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, finish, chars, d1, d2 of every line and paragraph of keyed documents."""

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch[ID], batch[KEY], batch[TEXT]):
                for row in units(text):
                    rows.append((doc_id, key, *row))
                    if len(rows) >= CHUNK:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)
        release_memory()

    def _frame(rows):
        names = [ID, KEY, "start", "finish", "chars", "d1", "d2"]
        return pd.DataFrame(rows, columns=names).astype({ID: "Int64"} | dict.fromkeys(names[1:], "int64"))

    shape = f"{ID} long, {KEY} long, start long, finish long, chars long, d1 long, d2 long"
    return docs.select(ID, KEY, TEXT).mapInPandas(cut, shape)


def _outer(start: np.ndarray, finish: np.ndarray):
    """start, finish of the spans, given by start and the longest first, that do not lie inside one before them."""
    reached = np.maximum.accumulate(np.concatenate(([-1], finish[:-1])))
    outer = finish > reached
    return start[outer], finish[outer]


def _without(text: str, start: np.ndarray, finish: np.ndarray) -> str:
    """``text`` without its spans, by start, each together with the line break after it (before it, at the end)."""
    parts, at = [], 0
    for start, end in zip(start.tolist(), finish.tolist()):
        parts.append(text[at:start])
        at = end + 1 if text[end : end + 1] == "\n" else end
    left = "".join([*parts, text[at:]])
    return left[:-1] if at >= len(text) and left.endswith("\n") else left


def repeated_units(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, finish, chars of every line and paragraph that has an earlier one of the same digest.

    The order is (doc_id, key, start), a null id first. Digests are grouped with map-side combining:
    a unit that is in every document is one row per task, and only digests and offsets are shuffled.
    """
    found = unit_digests(docs)
    place = F.struct(ID, KEY, "start")
    repeated = (
        found.groupBy("d1", "d2")
        .agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("d1", "d2", "earliest")
    )
    # written, so that both sides of the join are plain shuffles and a hot unit can be split
    repeated = written(repeated, "units")
    return found.join(repeated, ["d1", "d2"]).where(place > F.col("earliest")).select(ID, KEY, "start", "finish", "chars")


def dedup_units(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, every row and column, with ``text`` reduced to first occurrences, and four more columns.

    Units are the lines that are not blank and the paragraphs of two or more such lines, compared in lower case with
    white space runs as one space. In the order of (doc_id, start) the first of equal units is no repeat and the others
    are, in the same document too; ``n_repeated`` counts these. Repeats of ``min_chars`` characters or more go, each with
    its line break; shorter ones, such as a closing word on a line of its own, stand in unrelated texts and stay.
    ``removed`` is an array of (start, finish) in code points of the text as given, by start (empty if none; lines inside
    a removed paragraph are part of it), ``n_removed`` its size, ``kept_chars`` the length left (null text: null text, 0,
    0, 0). Rows that agree in doc_id and text are one document. Equal names among the other columns are replaced.
    """

    @pandas_udf(f"{TEXT} string, start array<long>, finish array<long>")
    def without(texts: pd.Series, starts: pd.Series, finishes: pd.Series) -> pd.DataFrame:
        rows = []
        for text, start, finish in zip(texts, starts, finishes):
            if text is None:
                rows.append((None, None, None))
            else:
                start, finish = _outer(start, finish)
                rows.append((_without(text, start, finish), start, finish))
        return pd.DataFrame(rows, columns=[TEXT, "start", "finish"], dtype=object)

    wide = docs.withColumn(KEY, F.xxhash64(F.coalesce(F.col(TEXT).cast("string"), F.lit(""))))
    span = F.struct("start", (-F.col("finish")).alias("back"))
    gone = repeated_units(keyed(docs)).groupBy(ID, KEY).agg(
        F.size(F.collect_set(span)).alias("n_repeated"),  # rows that agree in id and text repeat their units
        F.array_sort(F.collect_set(F.when(F.col("chars") >= min_chars, span))).alias("_llm_spans"),
    )
    none = F.array().cast("array<struct<start:bigint,finish:bigint>>")
    # by start, the longest first; only texts that lose something pass through Python
    spans = F.when(F.size("_llm_spans") > 0, F.col("_llm_spans"))
    starts, finishes = F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: -s["back"])
    marked = attach(wide.drop("removed", "n_repeated"), gone)
    left = marked.withColumn("_llm_left", without(F.when(spans.isNotNull(), F.col(TEXT)), starts, finishes))
    return (
        left.withColumn("removed", F.coalesce(F.arrays_zip("_llm_left.start", "_llm_left.finish"), none))
        .withColumn(TEXT, F.when(F.size("removed") > 0, F.col(f"_llm_left.{TEXT}")).otherwise(F.col(TEXT)))
        .withColumn("n_repeated", F.coalesce("n_repeated", F.lit(0)).cast("long"))
        .withColumn("n_removed", F.size("removed").cast("long"))
        .withColumn("kept_chars", F.coalesce(F.length(TEXT), F.lit(0)).cast("long"))
        .drop(KEY, "_llm_spans", "_llm_left")
    )

import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.substring_dedup import dedup_units


def cut(text):
    """(start, end, plain) of lines and of paragraphs of several lines."""
    found, paragraph = [], []
    lines = (text or "").split("\n")
    for k, line in enumerate([*lines, ""]):
        start = sum(len(x) + 1 for x in lines[:k])
        if line.split():
            paragraph.append((start, start + len(line)))
            found.append((start, start + len(line), " ".join(line.split())))
            continue
        if len(paragraph) > 1:
            a, b = paragraph[0][0], paragraph[-1][1]
            found.append((a, b, " ".join(text[a:b].split())))
        paragraph = []
    return sorted(found)


def plain(rows, min_chars):
    """(removed spans, repeats) of each document; rows of one id and text are one document."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        removed, repeats = [], 0
        for a, b, norm in cut(text):
            if norm.lower() in seen:
                repeats += 1
                if len(norm) >= min_chars:
                    removed.append((a, b))
            seen.add(norm.lower())
        outer = [(a, b) for a, b in removed if not any((x, y) != (a, b) and x <= a and b <= y for x, y in removed)]
        out[doc_id, text] = (sorted(outer), repeats)
    return sorted([(d, *out[d, t]) for d, t in rows], key=str)


ROWS = [
    (1, "One two  three four five.\nshort\nsix seven eight nine ten"), (2, "é one TWO three four five.\nshort\nx"),
    (3, "intro é\none two three four five.\nlast line"), (4, None), (5, ""), (6, "\n\n"), (7, "six seven eight nine ten"),
    (7, "six seven eight nine ten"), (8, "a b c d e f g h i j\na b c d e f g h i j\na b c d e f g h i j"),
    (None, "null id is the very first"), (9, "null id is the very first\n"),
]
WRAPPED = [
    (20, "p one two three\nfour five six\n\nother para is here now"), (21, "p one two three four five six"),
    (22, "before\n\np one two\nthree four five six\n \t\nafter"), (23, "p one two three four five six\nand more of it\n\nlast"),
    (24, "x\n\nP ONE two three four five six\nand more of it"),
]


@pytest.mark.parametrize("min_chars", [1, 12, 20, 80])
def test_spans(documents, min_chars):
    rows = [*ROWS, *WRAPPED]
    result = dedup_units(documents(rows), min_chars).collect()
    found = [(r["doc_id"], [(s["start"], s["finish"]) for s in r["removed"]], r["n_repeated"]) for r in result]
    assert sorted(found, key=str) == plain(rows, min_chars)
    assert all(r["n_removed"] == len(r["removed"]) and r["kept_chars"] == len(r["text"] or "") for r in result)


def test_kept_text(documents):
    kept = {r["doc_id"]: r["text"] for r in dedup_units(documents([*ROWS, *WRAPPED]), 12).collect()}
    assert kept[3] == "intro é\nlast line" and kept[7] == "" and kept[8] == "a b c d e f g h i j" and kept[9] == "" and kept[4] is None
    assert kept[1] == ROWS[0][1] and kept[2] == ROWS[1][1]
    assert kept[21] == "" and kept[22] == "before\n\n \t\nafter" and kept[24] == "x\n"


def test_long_passage_over_documents(documents):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own text number {i} of this document\n{passage}\nby.\nthe end of {i} is here now") for i in range(50)]
    found = {r["doc_id"]: (r["n_removed"], r["n_repeated"]) for r in dedup_units(documents(rows)).collect()}
    assert found == {i: (int(i > 0), 2 * int(i > 0)) for i in range(50)}


def test_listing_with_many_repeats(spark):
    """Time grows with the repeats of a document, not with their square: over a minute for this one before."""
    n = 60_000
    line = lambda i: F.concat(F.lit("entry "), i.cast("string"), F.lit(" of a listing that goes on for rather more than eighty characters " + "x" * 30))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), line), "\n\n")
    docs = spark.range(2).select(F.col("id").alias("doc_id"), text.alias("text"))
    began = time.time()
    found = {r["doc_id"]: (r["n_removed"], r["n_repeated"], r["kept_chars"]) for r in dedup_units(docs).drop("text", "removed").collect()}
    assert time.time() - began < 40
    assert found[1] == (n, n, n - 2) and found[0][:2] == (0, 0)


def test_texts_that_lose_nothing_do_not_pass_through_python(documents):
    plan = dedup_units(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [without(CASE WHEN") == 1 and plan.count("ArrowEvalPython") == 1


def test_empty_table(documents):
    assert dedup_units(documents([])).count() == 0


def test_query_counts_short_lines_and_lines_without_spaces(spark, tmp_path):
    from ledgerline.llm.queries import QUERIES

    long = "日本語の長い行" * 12
    rows = [(1, f"All rights reserved.\nx\n\n{long}"), (2, f"all  rights reserved.\ny\n\n{long}"), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["removed_spans"], r["n_repeated"]) for r in QUERIES["op2_substring_dedup"](spark, str(tmp_path)).collect()}
    assert found == {1: ("", 0), 2: ("25:109", 2), 3: ("", 1)}

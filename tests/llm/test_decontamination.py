import random
import re

import pytest

from ledgerline.llm.decontamination import contamination, item_windows, prefix_postings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window=13):
    out = []
    for doc_id, text in rows:
        own, hit, ids = words(text), set(), set()
        for item_id, item in items:
            theirs = words(item)
            size = min(window, len(theirs))
            for i in range(len(theirs) - size + 1 if size else 0):
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == theirs[i : i + size]:
                        hit |= set(range(j, j + size))
                        ids |= {str(item_id)} - {"None"}
        out.append((doc_id, len(own), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def check(spark, documents, rows, items):
    benchmark = spark.createDataFrame([(i, t, "?", "?") for i, t in items], "item_id long, text string, token string, n_words string")
    found = contamination(documents(rows), benchmark).collect()
    assert all(r["n_items"] == len(r["items"]) for r in found)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found), key=str) == plain(rows, items)


LONG = " ".join(f"w{i}" for i in range(40))


def test_edges(spark, documents):
    items = [
        (1, LONG), (2, "Short item, FOUR words"), (3, None), (4, ""), (5, "é-à"), (None, " ".join(f"n{i}" for i in range(13))),
        (6, LONG), (7, " ".join(f"w{i}" for i in range(5, 18))), (8, "one"), (7, "a a a a a a a a a a a a a a a a a"),
    ]
    rows = [
        (1, f"x {LONG} y"), (2, " ".join(f"w{i}" for i in range(12))), (3, " ".join(f"W{i}," for i in range(13))), (4, None), (5, ""),
        (6, "é À nothing"), (7, "short ITEM four;words"), (8, " ".join(["filler"] * 400) + " " + " ".join(f"w{i}" for i in range(20, 33))),
        (9, " ".join(f"n{i}" for i in range(20))), (10, "a " * 30), (None, "one"), (11, "one two"), (11, "one two"), (11, "other"),
        (12, " ".join(f"w{i}" for i in range(6)) + " gap " + " ".join(f"w{i}" for i in range(7, 20))), (13, "é à"),
    ]
    check(spark, documents, rows, items)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, documents, seed):
    """Few different words, so shingles repeat within items and across them."""
    draw = random.Random(seed)
    items = [(i, " ".join(draw.choices("abc", k=draw.randint(1, 30)))) for i in range(8)]
    rows = []
    for doc_id in range(30):
        text = draw.choices("abcd", k=draw.randint(0, 30))
        source = words(draw.choice(items)[1])
        at = draw.randint(0, len(source))
        rows.append((doc_id, " ".join([*text, *source[at : at + draw.randint(1, 25)], *draw.choices("abcd", k=5)])))
    check(spark, documents, rows, items)


def test_weak_filter_changes_nothing(spark, documents):
    benchmark = spark.createDataFrame([(1, LONG), (2, "some other words of an item")], "item_id long, text string")
    docs = documents([(i, f"a{i} b{i} c{i} " * 30 + (LONG if i % 5 == 0 else "")) for i in range(20)])
    strong, weak = (contamination(docs, benchmark, filter_bits=bits).collect() for bits in (1 << 24, 64))
    assert sorted(strong, key=str) == sorted(weak, key=str)


def test_postings_cover_every_window(spark):
    items = item_windows(spark.createDataFrame([(1, LONG)], "item_id long, text string"), 13, 5)
    none = spark.createDataFrame([], "token long, n long")
    covered = {w for r in prefix_postings(items, none).collect() for w in range(r["low"], r["high"] + 1)}
    assert covered == set(range(40 - 13 + 1))


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert contamination(documents([]), benchmark).count() == 0
    assert [r["n_hit"] for r in contamination(documents([(1, "a b")]), benchmark).collect()] == [0]

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import periodic_runs as ops
from ledgerline.llm.queries import op13_periodic_runs, with_repeats


def plain(words, least=24):
    """Runs by comparing the words with those p later, for each p."""
    best = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sequence(rng, length, letters):
    words = [rng.randrange(letters) for _ in range(length)]
    for _ in range(rng.randint(0, 3) if length else 0):
        block = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        start = rng.randrange(length)
        size = rng.randint(1, length - start)
        words[start : start + size] = (block * length)[:size]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_extensions(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = [-1, *sequence(rng, rng.randint(2, 200), rng.choice([1, 2, 3, 40])), -2]
        grammar = ops.Grammar(np.array(words) + 2)
        pairs = [(i, j) for i, j in ((rng.randrange(1, len(words)), rng.randrange(1, len(words))) for _ in range(40)) if i != j]
        for back in (False, True):
            want = []
            for i, j in pairs:
                k = 0
                while words[i - k - 1] == words[j - k - 1] if back else max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                want.append(k)
            assert grammar.extend(*np.array(pairs).reshape(-1, 2).T, back=back).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_plain_comparison(seed):
    rng = random.Random(seed)
    for _ in range(60):
        parts = [sequence(rng, rng.choice([0, 1, 5, 23, 24, 25, 30, 60, 100, 200, 400]), rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 8))]
        least = rng.choice([24, 24, 24, 3, 7])
        got = [[tuple(r) for r in runs.tolist()] for runs in ops.runs_of([np.array(p, np.int64) for p in parts], least)]
        assert got == [plain(p, least) for p in parts]


def test_grammar_is_small():
    grammar = ops.Grammar(np.array([0, *[2, 3, 4] * 30_000, 1]))
    assert len(grammar.symbols[-1]) == 1 and sum(map(len, grammar.symbols[3:])) < 4 * 90_000
    assert ops.runs_of([np.tile([5, 6, 7], 30_000), np.zeros(100_000, np.int64)])[1].tolist() == [[0, 100_000, 1]]


def test_edges(documents):
    tens = " ".join(str(k) for k in range(10))
    texts = [
        None, "", " \t", "a", "a " * 24, "a " * 23, f"x {tens} {tens} {tens} y", f"{tens}\n{tens}\r\n{tens} 0 1", "é é " * 30, "z " * 5000 + "q r " * 40,
        " ".join(str(k) for k in range(20_000)), "a b " * 13 + "c " * 30 + "a b " * 13,
    ]
    rows = [(k or None, text) for k, text in enumerate(texts)] * 2
    result = ops.find_runs(documents(rows)).collect()
    assert len(result) == len(rows)
    for row in result:
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        runs = plain(words) if len(words) < 4000 else [tuple(r) for r in row["runs"]]
        assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (len(words), runs, kept(words, runs))
        assert row["start"] == row["_found"] == "?"
    assert ops.find_runs(documents([])).count() == 0


def test_query_equals_plain(spark, sf_dir):
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 3000:
            continue
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain(words)
        with_runs += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        row = got[doc_id]
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == four
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert row["n_runs"] == len(runs) and row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()
    assert with_runs > 5


def test_repeats_of_odd_rows(documents):
    rows = [(k, text) for k in range(200) for text in (None, "", "one", "a b\tc  d")] + [(None, "a b c")]
    found = with_repeats(documents(rows)).select("doc_id", "text").collect()
    for doc_id, text in found:
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is None or h % 10:
            assert text in (None, "", "one", "a b\tc  d", "a b c")
        else:
            assert text in (None, "", "one") or len(text.split(" ")) == 4

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import simhash
from ledgerline.llm.components import connected_components


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbÉé \t\n\x0b\x1c  "), max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(str(i * i) for i in range(40_000))
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def brute(rows, max_bits=2):
    """Components by comparing all fingerprints with each other."""
    prints = [simhash.fingerprint(t) % (1 << 64) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= max_bits and label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc_id, _), group in zip(rows, label):
        if doc_id is not None:
            least[group] = min(doc_id, least.get(group, doc_id))
    return sorted(((d, least.get(g)) for (d, _), g in zip(rows, label)), key=str)


def test_edges_and_copies(documents):
    base = " ".join(f"word{i}" for i in range(400))
    near = [" ".join(f"word{i}" if i != k else "other" for i in range(400)) for k in range(0, 400, 29)]
    rows = [(5, base), (3, base), (3, base), (None, base), (9, None), (8, ""), (7, "  \n"), (1, "one two"), (2, "ONE TWO")]
    rows += [(100 + i, t) for i, t in enumerate(near)] + [(200 + i, f"lonely {i} text {i * 7} here") for i in range(20)]
    found = simhash.near_duplicates(documents(rows))
    assert found.columns == ["doc_id", "simhash", "component_id"]
    assert sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str) == brute(rows)


def test_links_of_many_close_fingerprints(spark):
    """A dense ball of fingerprints: posting lists over the small-list bound, chains of links."""
    random = np.random.default_rng(4)
    base = int(random.integers(1 << 62))
    values = {base}
    while len(values) < 1200:
        values.add(base ^ sum(1 << int(b) for b in random.choice(20, random.integers(1, 7), replace=False)))
    values |= {int(v) for v in random.integers(1 << 62, size=300)}
    values = sorted(values)
    table = spark.createDataFrame([(v,) for v in values], "simhash long")
    components = {r["node"]: r["component"] for r in simhash.connected_components(simhash.fingerprint_links(table)).collect()}
    array = np.array(values, np.int64).view(np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 2
    left, right = np.nonzero(np.triu(near, 1))
    nodes, roots = simhash.local_components(np.array(values)[left], np.array(values)[right])
    assert components == dict(zip(nodes.tolist(), roots.tolist()))


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0


def test_whole_table(spark, sf_dir):
    from ledgerline.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op10_simhash_near_dedup"](spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == brute(rows)
    prints = dict(rows)
    assert all(r["fingerprint"] == f"{plain(prints[r['doc_id']]):016x}" for r in found)


def test_one_row_of_each_group(spark):
    a, b = "the quick brown fox jumps over it", "an entirely different text stands here"
    rows = [(3, a, "en"), (3, a, "de"), (3, a, "de"), (None, a, "en"), (4, b, None), (4, b, None), (None, "third words of another kind", "en"), (9, None, "x"), (8, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str)
    assert len(left) == 4 and {r[:2] for r in left} == {(3, a), (4, b), (None, "third words of another kind"), (8, "")}
    again = sorted(map(tuple, simhash.one_of_each(docs.orderBy("lang").repartition(3)).collect()), key=str)
    assert again == left
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_a_component_of_a_third_of_all_fingerprints(spark):
    """A chain of fingerprints, each two bits from the next, beside as many single ones."""
    chain, value = [], 0
    for k in range(400):
        value ^= 0b11 << (2 * (k % 31))
        chain.append(value)
    chain = list(dict.fromkeys(chain))
    rng = random.Random(3)
    single = [rng.getrandbits(63) for _ in range(2 * len(chain))]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in dict.fromkeys(chain + single)], "simhash long"))
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {found[v] for v in chain} == {min(chain)} and not set(single) & set(found)

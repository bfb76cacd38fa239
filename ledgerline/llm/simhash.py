"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits."""

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerline.llm.components import connected_components, local_components
from ledgerline.llm.texts import ID, TEXT, attach
from ledgerline.sources.shared import written

BLOCK = 1 << 14


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed long.

    A-Z is lower-cased, words are cut at ASCII white space, and every shingle of ``shingle_words`` words
    (repeats included; a shorter text is one shingle) votes with the bits of its XXH64, seed 42. A bit is
    set if over half the shingles have it. No words: 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle_words, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        octets = hashes[start : start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, *more: str) -> DataFrame:
    """doc_id and simhash (long) of every row, and the columns that ``more`` names."""

    @pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text, shingle_words) for text in texts], dtype="int64")

    return docs.select(F.col(ID).cast("long").alias(ID), simhash(F.col(TEXT).cast("string")).alias("simhash"), *more)


@lru_cache
def _byte_sets(max_bits: int) -> list[int]:
    """Masks of every set of 8 - max_bits byte positions, as signed longs."""
    masks = [sum(0xFF << 8 * i for i in kept) for kept in combinations(range(8), 8 - max_bits)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


@lru_cache
def _flips(free_mask: int, max_bits: int) -> np.ndarray:
    """Every way to change one to max_bits bits of free_mask."""
    bits = [1 << i for i in range(64) if free_mask >> i & 1]
    sets = [c for n in range(1, max_bits + 1) for c in combinations(bits, n)]
    return np.array([sum(c) for c in sets], np.uint64)


def _tally(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints of each pair share."""
    return (np.ascontiguousarray(left).view(np.uint8) == np.ascontiguousarray(right).view(np.uint8)).reshape(-1, 8).sum(axis=1)


def _bucket_links(members: np.ndarray, mask: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the distinct fingerprints of one list, thinned to a star per local component.

    The candidate pairs of a short list are all its pairs, those of a long one the members that differ by some flip
    in the bytes the list leaves open. Each candidate's shared positional bytes are tallied, pairs that reach
    8 - max_bits are kept, and their bits are counted.
    """
    members = np.sort(members.astype(np.int64).view(np.uint64))
    if len(members) <= 128:
        left, right = np.triu_indices(len(members), 1)
    else:
        found = []
        for flip in _flips(~mask & (1 << 64) - 1, max_bits):
            wanted = members ^ flip
            at = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
            hit = np.nonzero((members[at] == wanted) & (members < wanted))[0]
            found.append((hit, at[hit]))
        left, right = (np.concatenate(side) for side in zip(*found))
    near = _tally(members[left], members[right]) >= 8 - max_bits
    left, right = left[near], right[near]
    near = np.bitwise_count(members[left] ^ members[right]) <= max_bits
    left, right = left[near], right[near]
    nodes, roots = local_components(members[left].view(np.int64), members[right].view(np.int64))
    return nodes[nodes != roots], roots[nodes != roots]


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct ``simhash`` values at most ``max_bits`` bits apart.

    Two such fingerprints differ in at most max_bits of their eight bytes, so their tally of shared
    positional bytes is at least 8 - max_bits. The index therefore lists each fingerprint under its sets
    of that many positional bytes: pairs that reach the minimum meet in a posting list and no others do.
    Members of a list differ only in max_bits bytes, which bounds it at 256 ** max_bits distinct values
    whatever the corpus. Bits are verified inside the list, and a chain of links leaves it as a star, so
    no group is written out as pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return distinct.select(F.col("simhash").alias("a"), F.col("simhash").alias("b")).limit(0)
    masks = _byte_sets(max_bits)
    postings = F.explode(
        F.array(*[F.struct(F.lit(i).alias("slot"), F.col("simhash").bitwiseAND(F.lit(m)).alias("octets")) for i, m in enumerate(masks)])
    )
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (
        distinct.repartition(spread, F.hash("simhash"))  # few bytes come in, many times more go out
        .select("simhash", postings.alias("p"))
        .groupBy("p.slot", "p.octets")
        .agg(F.collect_list("simhash").alias("members"))
        .where(F.size("members") > 1)
    )

    def link(batches):
        for batch in batches:
            pairs = [_bucket_links(m, masks[s], max_bits) for s, m in zip(batch["slot"], batch["members"])]
            yield pd.DataFrame(
                {"a": np.concatenate([p[0] for p in pairs] or [[]]), "b": np.concatenate([p[1] for p in pairs] or [[]])}
            ).astype("int64")

    return lists.select("slot", "members").mapInPandas(link, "a long, b long")


def _components(prints: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(simhash and first_id of every different fingerprint; node and component of those that are linked)."""
    classes = prints.groupBy("simhash").agg(F.min(ID).alias("first_id"))
    return classes, connected_components(fingerprint_links(classes.select("simhash"), max_bits))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, simhash (long), component_id (smallest doc_id reachable over links, itself included).

    One row per row of ``docs``. Equal fingerprints are one node from the start, so exact copies cost one
    row. Null and empty texts have fingerprint 0 and are linked like any other. Rows with one doc_id are
    rows of their own that share their component if their fingerprints do; a null doc_id never names a
    component unless all ids of it are null. An empty table gives an empty table. Other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle_words), "simhash")
    classes, components = _components(prints, max_bits)
    least = components.join(classes.withColumnRenamed("simhash", "node"), "node").groupBy("component").agg(F.min("first_id").alias("least_id"))
    merged = attach(
        classes.join(components.withColumnRenamed("node", "simhash"), "simhash", "left").select(
            "simhash", F.coalesce("component", "simhash").alias("component"), "first_id"
        ),
        written(least, "least-ids"),  # written, so that a component of a third of all fingerprints can be split
        ["component"],
    ).select("simhash", F.coalesce("least_id", "first_id").alias("component_id"))
    # written, so that both sides of the join are plain shuffles and the rows of a hot fingerprint can be split
    return prints.join(written(merged, "judged-prints"), "simhash").select(ID, "simhash", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the least by doc_id, a null id last, then by a row digest.

    Groups are found by text, so rows that share an id and differ in text are judged by themselves. A row is
    known by a 128-bit digest of all its columns; rows that are equal in all of them are one, which is settled before
    anything is joined, so a row repeated in a third of the table is no hot key.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"}))
    known = docs.withColumn("_llm_row", row)
    prints = written(fingerprints(known, shingle_words, "_llm_row"), "simhash")
    first = F.min(F.struct(F.col(ID).isNull().alias("unnamed"), ID, "_llm_row")).alias("first")
    firsts = written(prints.groupBy("simhash").agg(first), "first-rows")
    components = connected_components(fingerprint_links(firsts.select("simhash"), max_bits)).withColumnRenamed("node", "simhash")
    grouped = firsts.join(components, "simhash", "left").groupBy(F.coalesce("component", "simhash").alias("group"))
    chosen = grouped.agg(F.min("first").alias("first")).select("first._llm_row")
    return known.dropDuplicates(["_llm_row"]).join(chosen, "_llm_row", "left_semi").drop("_llm_row")

"""Benchmark decontamination: a prefix-filtered join of word shingles, verified word by word."""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.texts import ID, KEY, TEXT, attach, keyed
from ledgerline.sources.shared import written

WINDOW = 13
SHINGLE = 5
FILTER_BITS = 1 << 24

#: Word bytes keep their value (A-Z in lower case), all others become 0: digits, letters, and all of non-ASCII.
FOLD = np.array(
    [b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8
)
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, raised to 0 .. size - 1."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


class Words:
    """The words of a text: lower-cased bytes, where each word starts and ends, and a 64-bit hash of each."""

    def __init__(self, text: str):
        self.octets = FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], self.octets != 0, [False])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        size = 1 << max(16, len(self.octets).bit_length())
        up, down = _powers(size)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.octets * up[: len(self.octets)], dtype=np.uint64)))
        lengths = (self.ends - self.starts).astype(np.uint64)
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + lengths)

    def __len__(self):
        return len(self.starts)

    def strings(self, start: int, end: int) -> list[str]:
        pairs = zip(self.starts[start:end], self.ends[start:end])
        return [self.octets[s:e].tobytes().decode("utf-8", "replace") for s, e in pairs]

    def shingles(self, width: int) -> np.ndarray:
        """Hash of every run of ``width`` words."""
        count = max(0, len(self) - width + 1)
        total = np.full(count, width, np.uint64)
        for i in range(width):
            total = total * np.uint64(BASE) + self.hashes[i : i + count]
        return _mixed(total)


def _bits(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each token in a bit field of ``size`` bits, a power of 2."""
    shift = np.uint64(64 - size.bit_length() + 1)
    return tokens >> shift, (tokens * MIX) >> shift


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """A row per item with words: item_id, words, size (of its windows), width (of its shingles), tokens, item_key."""

    def cut(batches):
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch[TEXT]):
                words = Words(text or "")
                if len(words):
                    size = min(window, len(words))
                    width = min(shingle, size)
                    tokens = words.shingles(width).view(np.int64).tolist()
                    rows.append((item_id, words.strings(0, len(words)), size, width, tokens))
            frame = pd.DataFrame(rows, columns=["item_id", "words", "size", "width", "tokens"])
            yield frame.astype({"item_id": "Int64", "size": "int32", "width": "int32"})

    shape = "item_id long, words array<string>, size int, width int, tokens array<long>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(TEXT).cast("string").alias(TEXT))
    return items.mapInPandas(cut, shape).withColumn("item_key", F.xxhash64("words"))


def _filter_words(tokens: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``tokens``, as 64-bit words: at most bits / 64 rows come to the driver."""

    def place(batches):
        for batch in batches:
            found = np.concatenate(_bits(batch["token"].to_numpy(np.int64).view(np.uint64), bits))
            at, bit = found >> np.uint64(6), np.uint64(1) << (found & np.uint64(63))
            yield pd.DataFrame({"at": at.astype(np.int64), "bit": bit.view(np.int64)})

    field = tokens.select("token").mapInPandas(place, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits // 64, np.uint64)
    rows = field.toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def _document_runs(docs: DataFrame, shared, widths: list[int], window: int, bits: int) -> DataFrame:
    """Per keyed document n_words and its runs: words round the shingles that the filter lets pass.

    A run has the number of its first word, its words, and (place, token) of its shingles.
    """

    def scan(batches):
        for batch in batches:
            counts, all_runs = [], []
            field = shared.value
            for text in batch[TEXT]:
                words = Words(text)
                counts.append(len(words))
                found = []
                for width in widths:
                    tokens = words.shingles(width)
                    one, two = (
                        field[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) for p in _bits(tokens, bits)
                    )
                    at = np.flatnonzero(one & two)
                    found.extend(zip(at.tolist(), tokens[at].view(np.int64).tolist()))
                all_runs.append(_runs(words, sorted(found), window))
            yield pd.DataFrame({ID: batch[ID], KEY: batch[KEY], "n_words": counts, "runs": all_runs})

    shape = (
        f"{ID} long, {KEY} long, n_words long, "
        "runs array<struct<first:int,words:array<string>,tokens:array<struct<at:int,token:long>>>>"
    )
    return docs.select(ID, KEY, TEXT).mapInPandas(scan, shape)


def _runs(words: Words, found: list, window: int) -> list[dict]:
    runs: list[dict] = []
    last = -1
    for at, token in found:
        if not runs or at - window + 1 > last:
            runs.append({"first": max(0, at - window + 1), "tokens": []})
        last = min(len(words), at + window)
        runs[-1]["last"] = last
        runs[-1]["tokens"].append({"at": at, "token": token})
    return [{"first": r["first"], "words": words.strings(r["first"], r["last"]), "tokens": r["tokens"]} for r in runs]


def prefix_postings(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """What of the benchmark enters the join: token, item_id, at, low, high, size and words[low : high + size].

    A document that contains a window has all its shingles, so the prefix that must be shared is one
    shingle, and the rarest makes the fewest candidates (by occurrences in the documents, then by hash and
    place). ``low`` to ``high`` are the windows of an item that have this shingle at word ``at`` as their rarest.
    """
    each = items.select("item_id", "item_key", "size", "width", F.posexplode("tokens").alias("at", "token"))
    ranked = each.join(frequencies, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    last_window = F.array_size("tokens") + F.col("width") - F.col("size")
    sized = items.select("item_id", "item_key", last_window.alias("windows")).distinct()
    spread = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") + F.col("width") - F.col("size")), "at"))
    in_window = (
        attach(ranked, sized, ["item_id", "item_key"])
        .withColumn("window", spread)
        .where(F.col("window") < F.col("windows"))
    )
    rarest = in_window.groupBy("item_id", "item_key", "size", "window").agg(F.min(F.struct("n", "token", "at")).alias("least"))
    shared = rarest.groupBy("item_id", "item_key", "size", "least.token", "least.at").agg(
        F.min("window").alias("low"), F.max("window").alias("high")
    )
    words = items.select("item_id", "item_key", "words").dropDuplicates(["item_id", "item_key"])
    part = F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("size"))
    return attach(shared, words, ["item_id", "item_key"]).select("token", "item_id", "at", "low", "high", "size", part.alias("part"))


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates whose words hold a window: doc_id, key, item_id, and the words start to finish it covers.

    The windows of a posting that fit all have its shingle, so together they cover one stretch.
    """
    offset = F.col("place") - F.col("at") + F.col("low")  # word of the document where the posting's words begin
    equal = F.transform("part", lambda word, i: F.get(F.col("near"), F.col("offset") - F.col("first") + i) == word)
    fits = F.filter(
        F.sequence(F.lit(0), F.col("high") - F.col("low")),
        lambda j: F.forall(F.slice(F.col("equal"), j + 1, F.col("size")), lambda same: F.coalesce(same, F.lit(False))),
    )
    return (
        candidates.withColumn("offset", offset)
        .withColumn("equal", equal)
        .withColumn("fits", fits)
        .where(F.size("fits") > 0)
        .select(
            ID,
            KEY,
            "item_id",
            (F.col("offset") + F.array_min("fits")).alias("start"),
            (F.col("offset") + F.array_max("fits") + F.col("size")).alias("finish"),
        )
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, KEY, n_words, n_hit, n_items (long), items (sorted id strings), contaminated; a row per document row.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A window is ``window``
    consecutive words of an item, or the whole of a shorter one; a word inside any occurrence of a window is
    hit. A document is contaminated if words are hit and they are a twentieth of its words or more. Null and
    empty texts have no words; items without words have no windows, and an empty benchmark hits nothing. Items
    that repeat count once; an item without id hits words but is not listed. Rows that agree in doc_id and
    text get equal results, and a null doc_id is an id of its own. Other columns are ignored.

    Only words round shingles that may be in the benchmark leave the scan: a Bloom filter of ``filter_bits`` bits,
    broadcast, decides that, and a larger benchmark makes it weaker but never wrong. The join on shingles and the word by
    word check decide the rest. A shingle that is in a third of all documents is one key with many rows on the
    documents' side only, which adaptive execution splits or joins without a shuffle.
    """
    spark = docs.sparkSession
    items = written(item_windows(benchmark, window, shingle), "items")
    tokens = items.select(F.explode("tokens").alias("token"))
    widths = [row["width"] for row in items.select("width").distinct().collect()]  # at most ``shingle`` values
    shared = spark.sparkContext.broadcast(_filter_words(tokens, filter_bits))
    scanned = written(_document_runs(keyed(docs), shared, sorted(widths), window, filter_bits), "runs")
    runs = scanned.select(ID, KEY, F.explode("runs").alias("run"))
    found = runs.select(ID, KEY, F.col("run.first").alias("first"), F.col("run.words").alias("words"), F.explode("run.tokens").alias("t"))
    frequencies = (
        runs.select(F.explode("run.tokens.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    begin = F.greatest(F.lit(0), F.col("t.at") - F.col("first") - window + 1)
    near = found.select(
        ID, KEY, F.col("t.at").alias("place"), F.col("t.token").alias("token"),
        (F.col("first") + begin).alias("first"), F.slice("words", begin + 1, F.lit(2 * window - 1)).alias("near"),
    )
    hits = _verified(near.join(prefix_postings(items, frequencies), "token"))
    before = Window.partitionBy(ID, KEY).orderBy("start", "finish").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("finish") - F.greatest(F.col("start"), F.coalesce(F.max("finish").over(before), F.lit(0)))
    per_doc = (
        hits.withColumn("fresh", F.greatest(F.lit(0), fresh))
        .groupBy(ID, KEY)
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return attach(scanned.select(ID, KEY, "n_words"), per_doc).select(
        ID,
        KEY,
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )

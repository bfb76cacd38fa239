"""Token counts: batch encoding of pieces between safe boundaries; only lengths leave the workers."""

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgerline.llm.texts import TEXT

#: Bytes of text that are cut and encoded together, and characters from which a piece without spaces is cut further.
BATCH_BYTES = 1 << 22
LONG_PIECE = 1 << 12

#: Places inside a piece that no token of a white-space-dropping tokenizer spans: between ASCII digits, which are
#: tokens of their own, and after an ideographic comma or stop before an ideograph.
SAFE = re.compile("(?<=[0-9])(?=[0-9])|(?<=[、。，])(?=[一-鿿])")

_loaded: dict = {}


def _tokenizer(path: str):
    """The tokenizer of a .json file as the ``tokenizers`` library has it, one per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def pieces(text: str) -> list[str]:
    """``text`` cut where no token, normalisation or special string can cross, without its spaces and line feeds.

    A space or line feed is white space to the tokenizer's pattern, composes with nothing and is part of no
    special string, so what stands on either side is encoded alike alone. Long pieces are cut at SAFE places too.
    """
    cut = text.replace("\n", " ").split(" ")
    if len(text) < LONG_PIECE or max(map(len, cut)) < LONG_PIECE:
        return cut
    return [part for piece in cut for part in ([piece] if len(piece) < LONG_PIECE else SAFE.split(piece))]


def counted(texts: list[str], encode) -> np.ndarray:
    """Tokens of each text; ``encode`` gives the lengths of a list of pieces, each different piece is given once."""
    cut = [pieces(text) for text in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    codes, different = pd.factorize(np.array([p for parts in cut for p in parts], dtype=object))
    lengths = np.array(encode(list(different)), np.int64)[codes]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def slices(octets: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows with ``most`` bytes at most, but one row at least."""
    total = np.concatenate([[0], np.cumsum(octets)])
    at = 0
    while at < len(octets):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def count_tokens(docs: DataFrame, path: str, most_tokens: int = 2048) -> DataFrame:
    """``docs``, every row and column, and n_bytes (of UTF-8), n_tokens (long) and over_limit (more than ``most_tokens``).

    ``path`` is a file of the ``tokenizers`` library (.json) that every worker can open, whose pattern drops white
    space and keeps each ASCII digit apart. Tokens are those of the library without added special tokens, truncation
    or padding; special strings inside a text count as the library takes them by default. Null is the empty text:
    0, 0 and false. Each row is judged by itself, so ids, ties and repeated rows do not matter. Columns of the
    three names are replaced. A piece without a safe place is encoded whole, however long.
    """
    if not path.endswith(".json"):
        raise ValueError(f"{path}: a tokenizer file ending in .json is needed")

    @arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(path)

        def encode(parts):
            return [len(found) for found in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

        for batch in batches:
            octets = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            found = [counted(batch.slice(at, to - at).to_pylist(), encode) for at, to in slices(octets)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())

    text = F.coalesce(F.col(TEXT).cast("string"), F.lit(""))
    return (
        docs.withColumn("n_tokens", tokens(text))
        .withColumn("n_bytes", F.octet_length(text).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > most_tokens)
    )

"""SentencePiece BPE encoding and decoding by backtracking over longest matches."""

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerline.llm.texts import ID, TEXT, release_memory

SPACE = "▁"
CACHED_CHUNKS = 200_000
CACHED_PAIRS = 400_000
NO_MERGE = float("-inf")
SLICE_ROWS = 64


def _fields(message: bytes):
    """(number, value) of the fields of a serialized protocol buffer: integers, or bytes for the rest."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            octet = message[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, message[at : at + size]
            at += size


class PieceBpe:
    """Encoder and decoder of a BPE model file with byte fallback and unchanged (identity) normalisation.

    A token sequence is the BPE encoding exactly if every two neighbours are: merging the characters of both
    from scratch must give back the two. So the encoder takes the longest piece at each place, steps to the
    next shorter one if it does not fit its left neighbour, goes back a token if none is left, and marks the
    place it leaves in a bitfield, since no valid encoding continues there.

    Texts are first cut where no merge can pass: between two characters that are neighbours in no piece.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = list(_fields(model.serialized_model_proto()))
        trainer = dict(_fields(dict(proto)[2]))
        normalizer = dict(_fields(dict(proto)[3]))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("needs a BPE model with byte fallback that marks spaces in front")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("needs a model that leaves texts unchanged but for marking spaces")
        self.prefix = bool(normalizer.get(3, 1))
        count = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(count)]
        self.bytes = [0] * 256
        self.byte_of = {}
        self.silent = set()
        self.ids, self.scores = {}, {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.bytes[self.byte_of[i]] = i
            elif model.is_control(i):
                self.silent.add(i)
            elif not model.is_unknown(i):
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
        if any(model.is_unused(i) for i in range(count)) or any(
            kind == 4 for number, value in proto if number == 1 for n, kind in _fields(value) if n == 3
        ):
            raise ValueError("user defined and unused pieces are not supported")
        self.unknown = model.unk_id()
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.whole = {piece: i for piece, i in self.ids.items() if self.merge(piece) == [piece]}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.whole.items():
            self.automaton.add_word(piece, (len(piece) - 1, i))
        self.automaton.make_automaton()
        if any(c not in self.whole for piece in self.ids if len(piece) > 1 for c in piece):
            raise ValueError("needs a model in which every character of a piece is a piece")
        self.widths = [len(piece) for piece in self.pieces]
        self.shorter = [self._shorter(piece) for piece in self.pieces]
        self.surfaces = [piece if piece in self.ids else None for piece in self.pieces]
        self.cut = self._cutter()
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: set[str] = set()

    def forget(self):
        """Empty the caches. They are bounded by number, but a worker keeps them beside the stages that come after."""
        for cache in (self.pairs, self.young, self.old):
            cache.clear()
        self.odd.clear()

    def _cutter(self) -> re.Pattern:
        """Matches the stretches of a text that are encoded on their own.

        A stretch is space marks, then signs, then letters, if no piece has one of these in front of a kind
        named earlier; if some piece has, letters and signs mix. A character that is in no piece of several
        characters stands alone.
        """
        joined = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        known = {c for pair in joined for c in pair} - {SPACE}
        letters = {c for c in known if c.isalpha()}

        def any_of(characters):
            return "[" + re.escape("".join(sorted(characters))) + "]" if characters else "(?!)"

        sign, letter, either = any_of(known - letters), any_of(letters), any_of(known)
        if any(pair[1] == SPACE != pair[0] for pair in joined):
            return re.compile(f"(?:{either}|{SPACE})+|.", re.DOTALL)
        if any(pair[0] in letters and pair[1] not in letters for pair in joined):
            return re.compile(f"{SPACE}+{either}*|{either}+|.", re.DOTALL)
        return re.compile(f"{SPACE}+{sign}*{letter}*|{sign}+{letter}*|{letter}+|.", re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """The plain way, for short texts: merge the best scored pair of neighbours, leftmost first."""
        parts, score = list(text), self.scores.get
        scores = [score(a + b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NO_MERGE:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NO_MERGE)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NO_MERGE)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their characters are merged again."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _shorter(self, piece: str) -> int:
        """The longest piece that begins this one, or -1."""
        return next((self.whole[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.whole), -1)

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a stretch. The path is a list, so its length is no limit."""
        single = self.whole.get(chunk)
        if single is not None:
            return [single]
        if len(chunk) == 1:  # a character without a piece: its bytes, which merge with nothing
            return [self.bytes[b] for b in chunk.encode()]
        size, widths, shorter, pairs = len(chunk), self.widths, self.shorter, self.pairs
        longest = [0] * size
        for last, (before, piece) in self.automaton.iter(chunk):
            longest[last - before] = piece  # matches come by their end, so the longest comes last
        failed = bytearray(size + 1)
        path: list[int] = []
        at, left, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                after = at + widths[piece]
                if not failed[after]:
                    fits = True if left < 0 else pairs.get(left << 32 | piece)
                    if fits or (fits is None and self.fits(left, piece)):
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                if after == size:
                    return path
                at, left, piece = after, piece, longest[after]
            else:
                failed[at] = 1
                last = path.pop()
                at -= widths[last]
                left = path[-1] if path else -1
                piece = shorter[last]

    def marked(self, text: str) -> str:
        """The text with spaces as marks and, if the model says so, one in front."""
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.cut.findall(self.marked(text)) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int], begins: bool = True) -> str:
        """Text of the ids. ``begins``: drop the space that encoding put in front."""
        try:
            text = "".join([self.surfaces[i] for i in ids]).replace(SPACE, " ")
            return text[1:] if begins and self.prefix and text[:1] == " " else text
        except TypeError:  # some ids are no plain pieces
            pass
        out, octets = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                octets.append(self.byte_of[i])
                continue
            if octets:
                out.append(_utf8(bytes(octets)))
                octets.clear()
            if i is None or i in self.silent:
                continue
            piece = self.unknown_surface if i == self.unknown else self.pieces[i]
            if begins and self.prefix and not out and piece.startswith(SPACE):
                piece = piece[1:]
                begins = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out)

    def _ids_of(self, chunk: str) -> str:
        """The ids of a stretch as decimals, from the younger or older cache or encoded anew.

        Encoding also decodes the ids; a stretch that they do not give back is remembered as odd.
        """
        found = self.old.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            found = ",".join(map(str, ids))
            if self.decode(ids, begins=False) != chunk.replace(SPACE, " "):
                self.odd.add(chunk)
        if len(self.young) >= CACHED_CHUNKS:
            self.old, self.young = self.young, {}
        self.young[chunk] = found
        return found

    def encode_and_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by commas, and the text decoded from them.

        Stretches decode one by one, since a character's bytes never part; the space in front goes last.
        """
        chunks = self.cut.findall(self.marked(text))
        found = list(map(self.young.get, chunks))
        if None in found:
            found = [self._ids_of(chunk) if ids is None else ids for chunk, ids in zip(chunks, found)]
        ids = ",".join(found)
        if self.odd and not self.odd.isdisjoint(chunks):
            decoded = self.decode([int(i) for i in ids.split(",")])
        else:
            decoded = "".join(chunks).replace(SPACE, " ")[self.prefix :]
        return ids.count(",") + 1 if ids else 0, ids, decoded


def _utf8(octets: bytes) -> str:
    """One replacement character for each byte that is no part of a character."""
    out = []
    while octets:
        try:
            return "".join([*out, octets.decode()])
        except UnicodeDecodeError as error:
            out.append(octets[: error.start].decode() + "�")
            octets = octets[error.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceBpe:
    """One coder for each model and Python worker; its caches are cleared when full, and by ``tokenize`` after each task."""
    return PieceBpe(path)


def tokenize(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs``, every row and column, and ids (array of int), n_tokens (long) and decoded (string).

    Null text is encoded like empty text: no ids, 0, and an empty string. Whole texts are encoded, and equal
    texts get equal ids. ``model_path`` must be readable on every executor. Columns of the three names are replaced.
    Ids and texts leave Python in slices of a batch, so a task holds the tokens of SLICE_ROWS rows.
    """
    kept = docs.drop("ids", "n_tokens", "decoded").withColumn(TEXT, F.col(TEXT).cast("string"))
    added = T.StructType.fromDDL("ids array<int>, n_tokens long, decoded string")

    def encode(batches):
        own = coder(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values, counts, decoded = [], [], []
                for text in part.column(TEXT).to_pylist():
                    count, ids, back = own.encode_and_decode(text or "")
                    values.append(np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32))
                    counts.append(count)
                    decoded.append(back)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))
                columns = [*part.columns, ids, pa.array(counts, pa.int64()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added.names])
            del batch, part
        own.forget()
        release_memory()

    return kept.mapInArrow(encode, T.StructType([*kept.schema.fields, *added.fields]))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens (long), ids_sha256 and decoded_sha256 of every row, without moving the ids out of Python.

    The digests are lowercase hex, of the decimal ids joined by commas and of the decoded text in UTF-8. Null
    text counts as empty.
    """

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own = coder(model_path)
        rows = []
        for text in texts:
            count, ids, decoded = own.encode_and_decode(text or "")
            rows.append((count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = docs.select(F.col(ID).alias(ID), digest(F.col(TEXT).cast("string")).alias("_llm_coded"))
    return coded.select(ID, "_llm_coded.*")

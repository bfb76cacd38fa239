"""Secret scans: patterns over a text and over every layer that is encoded in it, with spans of the text itself."""

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerline.llm.texts import ID, TEXT

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
LEAST_ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}"
    r"|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};"
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{2,})*={0,2}")
BLANKS = str.maketrans("-_", "+/", " \t\r\n")
#: What a packed stream begins with, wherever it stands in decoded bytes (zlib has too little of it).
MAGIC = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|\x28\xb5\x2f\xfd|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
#: Shorter decoded stretches cannot hold a secret, however they are encoded.
STRETCH = re.compile("[^�]{16,}")
PIECE = 1 << 22
#: A character repeated more often than this is no part of a packed stream (their raw blocks are shorter), and a secret or
#: an encoded run loses nothing but length if it goes on for less; left out are multiples of 12, which keeps alignments.
LONGEST_REPEAT = 1 << 20
#: Bytes that one text may unpack to, over all its layers; beyond, the row is marked as stopped.
MOST_UNPACKED = 1 << 28
#: Places that no encoded run and no secret goes over, before or after any decoding; a piece may end behind one.
SAFE = re.compile(r"""[^A-Za-z0-9+/_.=\s"':%\\{}&#;-]|(?<=\s)[A-Za-z]+\x20(?=[A-Za-z])|\n(?=\r?\n)""")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the secrets that stand in ``text`` as they are, by start, then kind.

    Per kind the leftmost matches that do not overlap; too short ones are dropped but have used their place.
    A match of the least length starts where a match of any length does, for runs of one set of characters.
    """
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[0], span[2]))


@dataclass
class Meter:
    """How many bytes a text may still unpack to, and whether it was stopped for want of them."""

    left: int = MOST_UNPACKED
    stopped: bool = False


@dataclass
class Layer:
    """A decoded text: ``starts`` and ``ends`` are the places in the root of each character, or of the whole (int)."""

    text: str
    starts: np.ndarray | int | None
    ends: np.ndarray | int | None
    path: str

    def root_span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def spliced(self, pieces: list, path: str) -> "Layer":
        """This layer with stretches replaced: pieces are (start, end, characters with their own ranges)."""
        parts, starts, ends, at = [], [], [], 0
        for start, end, characters in [*pieces, (len(self.text), len(self.text), [])]:
            parts.append(self.text[at:start])
            same = np.arange(at, start)
            starts.append(same)
            ends.append(same + 1)
            for character, a, b in characters:
                parts.append(character)
                starts.append([a] * len(character))
                ends.append([b] * len(character))
            at = end
        left, right = (np.concatenate(side).astype(np.int64) for side in (starts, ends))
        if isinstance(self.starts, int):
            return Layer("".join(parts), self.starts, self.ends, path)
        if self.starts is not None:
            left, right = self.starts[left], self.ends[right - 1]
        return Layer("".join(parts), left, right, path)


def _percent_pieces(text: str) -> list:
    """Percent-encoded bytes that are UTF-8, as characters; other bytes stay as they are written."""
    pieces = []
    for run in PERCENT.finditer(text):
        octets, at = bytes.fromhex(run.group().replace("%", "")), 0
        while at < len(octets):
            for width in (1, 2, 3, 4):
                try:
                    character = octets[at : at + width].decode()
                except UnicodeDecodeError:
                    continue
                if character:
                    start = run.start() + 3 * at
                    pieces.append((start, start + 3 * width, [(character, start, start + 3 * width)]))
                    at += width
                    break
            else:
                at += 1
    return pieces


def _unicode_pieces(text: str) -> list:
    pieces = []
    for found in UNICODE.finditer(text):
        code = found.group()
        if code.count("\\") == 2:
            value = 0x10000 + ((int(code[2:6], 16) & 0x3FF) << 10 | int(code[8:12], 16) & 0x3FF)
        elif code[0] == "&":
            value = int(code[3:-1], 16) if code[2] in "xX" else int(code[2:-1])
        else:
            value = int(code[2:].strip("{}"), 16)
        if value <= 0x10FFFF and not 0xD800 <= value < 0xE000:
            pieces.append((*found.span(), [(chr(value), *found.span())]))
    return pieces


def _from_base64(blob: str) -> bytes:
    """The bytes of standard or URL-safe base64, padded or not; an odd last character is dropped."""
    plain = blob.rstrip("=").translate(BLANKS)
    plain = plain[:-1] if len(plain) % 4 == 1 else plain
    return base64.b64decode(plain + "=" * (-len(plain) % 4))


def _unpacks(data: bytes) -> bool:
    """Whether data begins with a zlib stream, by its first 4 KB."""
    name, stream = _decompressor(data)
    try:
        return name == "zlib" and len(stream.decompress(data[: 1 << 12], 1 << 12)) >= 16
    except zlib.error:
        return False


def _base64_texts(run: str, path: str, meter: Meter) -> Iterator[tuple[str, str]]:
    """(text, path) of a run of base64 characters: as a whole, and of blobs that begin or end inside it.

    A prefix shifts the characters of a blob by 0 to 3, so the run is decoded in the four alignments; text shows
    as stretches of one of them, a packed stream by its first bytes. zlib is looked for behind / - _ + and line breaks.
    """
    plain = run.rstrip("=").translate(BLANKS)
    for shift in range(4):
        data = _from_base64(plain[shift:])
        left = [len(data)]
        yield from _texts(data, path, meter, shift == 0, left)
        for found in MAGIC.finditer(data):
            if found.start() and found.start() >= len(data) - left[0]:  # not inside a stream that was read
                yield from _texts(data[found.start() :], path, meter, False, left)
    for found in re.finditer(r"[/_+-]|\n[ \t]*", run):
        if _decompressor(_from_base64(run[found.end() : found.end() + 8]))[0] != "zlib":
            continue
        if _unpacks(_from_base64(run[found.end() : found.end() + 6000])):
            yield from _texts(_from_base64(run[found.end() :]), path, meter)


def _decompressor(data: bytes):
    """(name, decompressor) for data that begins like a compressed stream."""
    if data[:2] == b"\x1f\x8b":
        return "gzip", zlib.decompressobj(31)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor().decompressobj()
    if data[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor()
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib", zlib.decompressobj()
    return None, None


def _inflated(name: str, stream, data: bytes, left: list) -> Iterator[bytes]:
    """What the stream and further ones of its kind behind it hold, in parts of a few MB at most.

    Ends without a word where it is broken. ``left`` learns how many bytes are behind the last whole one.
    """
    try:
        while True:
            if name == "zstd":
                at = 0
                while at < len(data) and not stream.eof:
                    yield stream.decompress(data[at : at + (1 << 12)])
                    at += 1 << 12
                rest = stream.unused_data + data[at:]
            elif name in ("gzip", "zlib"):
                while data and not stream.eof:
                    yield stream.decompress(data, PIECE)
                    data = stream.unconsumed_tail
                rest = stream.unused_data
            else:
                yield stream.decompress(data, PIECE)
                while not stream.eof and not stream.needs_input:
                    yield stream.decompress(b"", PIECE)
                rest = stream.unused_data
            if not stream.eof:
                return
            left[0] = len(rest)
            data = rest.lstrip(b"\0")
            following, stream = _decompressor(data)
            if following != name:
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _texts(data: bytes, path: str, meter: Meter, whole: bool = True, left: list | None = None) -> Iterator[tuple[str, str]]:
    """(text, path) of decoded bytes: themselves, or what they unpack to; bytes that are no UTF-8 become U+FFFD.

    Of bytes that are not all UTF-8, the stretches that could hold a secret are given, with one U+FFFD between. Bytes
    that do not unpack are left out if there is no such stretch, unless they are UTF-8 and ``whole``.
    """
    name, stream = _decompressor(data)
    if name:
        yield from _unpacked(name, stream, data, path, [0] if left is None else left, meter)
    if name not in (None, "zlib"):
        return
    text = data.decode(errors="replace")
    stretches = "\ufffd".join(STRETCH.findall(text))
    if stretches:
        yield stretches, path
    elif whole and not name and text and "\ufffd" not in text:
        yield text, path


class _Held:
    """Text that waits for a safe place to end; what goes beyond LONGEST_REPEAT of one character in a row is left out."""

    def __init__(self):
        self.parts, self.size, self.repeat = [], 0, 0

    def add(self, text: str):
        if not text:
            return
        last = self.parts[-1][-1] if self.parts else ""
        same = len(text) - len(text.lstrip(last)) if last else 0
        spare = min(max(0, self.repeat + same - LONGEST_REPEAT), same) // 12 * 12
        text, same = text[spare:], same - spare
        if same == len(text):
            self.repeat += same
        else:
            repeat = _repeat(text)
            spare = max(0, repeat - LONGEST_REPEAT) // 12 * 12
            text, self.repeat = text[: len(text) - spare], repeat - spare
        if text:
            self.parts.append(text)
            self.size += len(text)

    def keep(self, last: str):
        self.parts, self.size, self.repeat = [last] if last else [], len(last), _repeat(last)


def _repeat(text: str) -> int:
    """How often the last character of a text is repeated at its end."""
    return len(text) - len(text.rstrip(text[-1])) if text else 0


def _unpacked(name: str, stream, data: bytes, path: str, left: list, meter: Meter) -> Iterator[tuple[str, str]]:
    """(text, path) of a packed stream, in pieces that end where no encoded run or secret is open."""
    decoder, held, packed = codecs.getincrementaldecoder("utf-8")("replace"), _Held(), b""
    begun = False
    parts = _metered(_inflated(name, stream, data, left), meter)
    for part in parts:
        if not begun:
            packed += part
            if len(packed) < 6:
                continue
            part, begun = packed, True
            if _decompressor(part)[0]:  # a stream in a stream: its packed bytes are held whole
                yield from _texts(b"".join([part, *parts]), f"{path}>{name}", meter)
                return
        held.add(decoder.decode(part))
        if held.size >= PIECE and (cut := _last_safe(held.parts[-1])):
            text = held.parts[-1]
            yield "".join([*held.parts[:-1], text[:cut]]), f"{path}>{name}"
            held.keep(text[cut:])
    held.add(decoder.decode(b"" if begun else packed, True))
    if last := "".join(held.parts):
        yield last, f"{path}>{name}"


def _metered(parts: Iterator[bytes], meter: Meter) -> Iterator[bytes]:
    for part in parts:
        if meter.left < len(part):
            meter.stopped = True
            return
        meter.left -= len(part)
        yield part


def _last_safe(text: str) -> int:
    """The end of the last SAFE place of a text, 0 if there is none."""
    width = 1 << 12
    while True:
        at = max(0, len(text) - width)
        last = max((m.end() for m in SAFE.finditer(text, at)), default=0)
        if last or not at:
            return last
        width <<= 6


def children(layer: Layer, meter: Meter) -> Iterator[Layer]:
    """The layers one decoding below, one at a time."""
    text = layer.text
    if "%" in text and (pieces := _percent_pieces(text)):
        yield layer.spliced(pieces, f"{layer.path}>url")
    if ("\\" in text or "&#" in text) and (pieces := _unicode_pieces(text)):
        yield layer.spliced(pieces, f"{layer.path}>unicode")
    for found in BASE64.finditer(text):
        blobs = [(found.start(), found.end(), _base64_texts(found.group(), f"{layer.path}>base64", meter))]
        if "\n" in found.group():  # lines of one blob, or blobs on lines of their own
            at = found.start()
            for line in found.group().split("\n"):
                blob = line.strip(" \t\r")
                if len(blob) >= 16:
                    start = at + line.index(blob)
                    blobs.append((start, start + len(blob), _texts(_from_base64(blob), f"{layer.path}>base64", meter)))
                at += len(line) + 1
        for start, end, decoded in blobs:
            for inner, path in decoded:
                yield Layer(inner, *layer.root_span(start, end), path)


def find(text: str, most_unpacked: int = MOST_UNPACKED) -> tuple[list, list, int, bool]:
    """(base spans, all spans, number of layers, stopped) of a text.

    A span is (start, end, kind number, path of decodings). Layers are worked off depth first until none is
    new; a layer is new unless the same text has come from the same place before, so a stream that unpacks to
    itself ends. A secret in a layer has the span of the characters, or of the blob, that it comes from. Unpacking
    stops for good when the layers together exceed ``most_unpacked`` bytes; what was found until then is given.
    """
    meter = Meter(most_unpacked)
    base = [(*span, "") for span in scan(text)]
    spans = {(start, end, kind): "" for start, end, kind, _ in base}
    seen, layers = set(), 0
    work = [children(Layer(text, None, None, ""), meter)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        place = (layer.starts, layer.ends) if isinstance(layer.starts, int) else None
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), place
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for start, end, kind in scan(layer.text):
            spans.setdefault((*layer.root_span(start, end), kind), layer.path[1:])
        work.append(children(layer, meter))
    ordered = sorted(((s, e, k, path) for (s, e, k), path in spans.items()), key=lambda x: (x[0], x[2], x[1]))
    return base, ordered, layers, meter.stopped


def find_secrets(docs: DataFrame, most_unpacked: int = MOST_UNPACKED) -> DataFrame:
    """``docs``, every row and column, and base, spans (arrays of kind, start, finish, layer), n_layers (long) and stopped.

    ``base`` are the secrets that stand in the text, ``spans`` these and the ones in decoded layers: URL and
    Unicode escapes, base64, and gzip, zlib, bzip2, xz or zstd inside it, in any order and depth. ``layer`` names
    the decodings (empty for base). Offsets are code points of the text, end exclusive, by start, then kind.
    Null and empty texts have none. Whole texts and whole layers are read, an unpacked stream in pieces that end where no encoded
    run is open, so memory is bounded by the text, by one piece or the longest run per level, and by the packed size of
    a stream inside a stream. A blob may begin or end inside a run of base64 characters, and bytes that are no UTF-8 are skipped. A
    character that repeats over a million times in a row is read that often. ``stopped`` marks the rows whose layers
    unpack to more than ``most_unpacked`` bytes and were not read to the end. Columns of the four names are replaced.
    """
    span = "array<struct<kind:string,start:long,finish:long,layer:string>>"

    @pandas_udf(f"base {span}, spans {span}, n_layers long, stopped boolean")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans, *rest = find(text or "", most_unpacked)
            rows.append((_named(base), _named(spans), *rest))
        return pd.DataFrame(rows, columns=["base", "spans", "n_layers", "stopped"])

    with_found = docs.withColumn("_llm_found", found(F.col(TEXT).cast("string")))
    for name in ("base", "spans", "n_layers", "stopped"):
        with_found = with_found.withColumn(name, F.col(f"_llm_found.{name}"))
    return with_found.drop("_llm_found")


def _named(spans: list) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "finish": e, "layer": path} for s, e, k, path in spans]

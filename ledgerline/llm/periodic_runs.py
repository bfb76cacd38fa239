"""Periodic runs of words: recompression into a run-length grammar, whose levels answer exact extensions."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgerline.llm.texts import TEXT

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of one grammar (a longer text is a grammar by itself), candidates extended together, and grid places looked at together.
CHUNK = 1 << 18
CANDIDATES = 1 << 13
GRID = 1 << 16

#: Words after a grid place that are looked at before it is a candidate, from the grid's step.
PROBES = (lambda d: 0 * d, lambda d: np.minimum(d, 1), lambda d: np.minimum(d, 2), lambda d: d // 2, lambda d: d)

RUNS = "array<struct<start:long,length:long,period:long>>"


class Grammar:
    """Recompression of a sequence: level by level, blocks of one symbol, then disjoint pairs, become new symbols.

    Each level keeps its symbols and where they start in the sequence. A symbol's borders depend on its neighbours
    only, so equal stretches are cut alike but for their ends, and ``extend`` walks up and down the levels in a few
    steps each. The sequence must begin and end with symbols that occur nowhere else in it.
    """

    def __init__(self, sequence: np.ndarray):
        self.size = len(sequence)
        self.symbols, self.starts, self.blocks = [sequence.astype(np.int32)], [np.arange(self.size, dtype=np.int32)], [False]
        self._fresh = int(sequence.max()) + 1
        salt = 0
        while len(self.symbols[-1]) > 1:
            self._compress_blocks()
            while len(self.symbols[-1]) > 1:
                salt += 1
                if self._compress_pairs(salt):
                    break

    def _add(self, names, first, blocks):
        self.symbols.append(names)
        self.starts.append(self.starts[-1][first])
        self.blocks.append(blocks)

    def _named(self, keys):
        different, names = np.unique(keys, return_inverse=True)
        names = (names + self._fresh).astype(np.int32)
        self._fresh += len(different)
        return names

    def _compress_blocks(self):
        symbols = self.symbols[-1]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        if len(first) == len(symbols):
            return
        lengths = np.diff(np.append(first, len(symbols)))
        names = symbols[first]
        long = lengths > 1
        names[long] = self._named(names[long].astype(np.int64) * (self.size + 1) + lengths[long])
        self._add(names, first, True)

    def _compress_pairs(self, salt) -> bool:
        """Pairs of a symbol of the first class and one of the second; a hash deals the classes, the better order is taken."""
        symbols = self.symbols[-1]
        mixed = symbols.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)
        second = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(31)).astype(bool)
        rising, falling = ~second[:-1] & second[1:], second[:-1] & ~second[1:]
        pair = rising if rising.sum() >= falling.sum() else falling
        at = np.flatnonzero(pair)
        if not len(at):
            return False
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        first = np.flatnonzero(keep)
        names = symbols[first]
        paired = np.concatenate([pair, [False]])[first]
        names[paired] = self._named(symbols[at].astype(np.int64) * self._fresh + symbols[at + 1])
        self._add(names, first, False)
        return True

    def _border(self, level, places):
        starts = self.starts[level]
        at = np.searchsorted(starts, places)
        return (places == self.size) | (starts[np.minimum(at, len(starts) - 1)] == places)

    def _next(self, level, places, back):
        """The border of the level next to each place: after it, or before it going ``back``."""
        starts = self.starts[level]
        if back:
            return starts[np.searchsorted(starts, places) - 1].astype(np.int64)
        at = np.searchsorted(starts, places, "right")
        return np.where(at < len(starts), starts[np.minimum(at, len(starts) - 1)], self.size).astype(np.int64)

    def _symbol(self, level, places, back):
        return self.symbols[level][np.searchsorted(self.starts[level], places, "left" if back else "right") - 1]

    def _step(self, level, i, j, back):
        """How far equal symbols of the level at i and j carry, up to the borders of the next level; 0 if they differ."""
        same = self._symbol(level, i, back) == self._symbol(level, j, back)
        above = level + 1 if self.blocks[level + 1] else level
        carried = np.minimum(np.abs(self._next(above, i, back) - i), np.abs(self._next(above, j, back) - j))
        return np.where(same, carried, 0)

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols are equal from i and j on, or before i and j going ``back``; i and j differ."""
        sign = -1 if back else 1
        i, j = i.astype(np.int64), j.astype(np.int64)
        begun = i.copy()
        stopped = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        for level in range(len(self.symbols) - 1):
            open_ = active[~(self._border(level + 1, i[active]) & self._border(level + 1, j[active]))]
            step = self._step(level, i[open_], j[open_], back)
            i[open_] += sign * step
            j[open_] += sign * step
            done = open_[(step == 0) | ~(self._border(level + 1, i[open_]) & self._border(level + 1, j[open_]))]
            stopped[done] = level
            active = np.setdiff1d(active, done, assume_unique=True)
            if not len(active):
                break
        stopped[active] = len(self.symbols) - 1
        for level in range(int(stopped.max(initial=0)) - 1, -1, -1):
            down = np.flatnonzero(stopped > level)
            step = self._step(level, i[down], j[down], back)
            i[down] += sign * step
            j[down] += sign * step
        return np.abs(i - begun)


def _sequence(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts, longest first, with a symbol of its own before each and at the end; and where each part starts."""
    count, most = len(parts), max((int(p.max()) for p in parts if len(p)), default=-1)
    order = sorted(range(count), key=lambda k: -len(parts[k]))
    sequence, begins, at = [], np.zeros(count, np.int64), 0
    for rank, k in enumerate(order):
        sequence += [np.array([most + 1 + rank]), parts[k]]
        begins[k] = at + 1
        at += 1 + len(parts[k])
    return np.concatenate([*sequence, [most + 1 + count]]), begins


def runs_of(parts: list[np.ndarray], least_words: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each sequence of word numbers its runs: rows (start, length, period), by start, then period.

    A run is a maximal stretch of smallest period q and a length of max(``least_words``, 3 q) or more. For each period p
    a grid of steps max(p, least_words / 3) has a place early in each run of period p; a place is a candidate if the
    words some probes further agree with those p later, and the grammar tells how far they do.
    """
    sequence, begins = _sequence(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    shrinking = np.sort(sizes)[::-1]
    ends = np.cumsum(shrinking + 1)
    owner = np.zeros((3, len(sequence)), np.int64)  # start, end and period of a run that covers the place
    grammar, found, waiting, held, flushed = None, [], [], 0, 0

    def flush():
        nonlocal grammar, waiting, held
        if not held:
            return
        grammar = grammar or Grammar(sequence)
        i, p = (np.concatenate(x) for x in zip(*waiting))
        waiting, held = [], 0
        start, end = i - grammar.extend(i, i + p, back=True), i + p + grammar.extend(i, i + p)
        whole = end - start >= np.maximum(least_words, LEAST_PERIODS * p)
        rows = np.unique(np.stack([start, end, p], axis=1)[whole], axis=0)
        for s, e, q in rows.tolist():
            owner[0, s:e], owner[1, s:e], owner[2, s:e] = s, e, q
        found.append(rows)

    most = int(shrinking[0]) // LEAST_PERIODS if len(parts) else 0
    periods = np.arange(1, most + 1)
    fitting = np.searchsorted(-shrinking, -np.maximum(least_words, LEAST_PERIODS * periods), "right")
    limits = np.where(fitting > 0, ends[fitting - 1], 0)
    steps = np.maximum(periods, max(1, least_words // LEAST_PERIODS))
    counts = np.maximum(0, -(-(limits - periods) // steps))
    done = np.cumsum(counts)
    low = 0
    while low < most:
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + GRID, "right")))
        count = counts[low:high]
        p, step = np.repeat(periods[low:high], count), np.repeat(steps[low:high], count)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * step
        for probe in PROBES:
            further = at + probe(step)
            inside = further + p < len(sequence)
            same = inside & (sequence[np.where(inside, further, 0)] == sequence[np.where(inside, further + p, 0)])
            at, p, step = at[same], p[same], step[same]
        if len(at):
            s, e, q = owner[:, at]
            new = ~((q > 0) & (p % np.maximum(q, 1) == 0) & (at + p < e) & (e - s >= p + q))
            if new.any():
                waiting.append((at[new], p[new]))
                held += int(new.sum())
        if held >= CANDIDATES or periods[high - 1] >= 2 * flushed:
            flush()
            flushed = int(periods[high - 1])
        low = high
    flush()
    if not found:
        return [np.zeros((0, 3), np.int64)] * len(parts)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch, the smallest period
    rows = rows[first]
    out = []
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        low, high = np.searchsorted(rows[:, 0], [begin, begin + size])
        mine = rows[low:high]
        mine = np.stack([mine[:, 0] - begin, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
        out.append(mine[np.lexsort((mine[:, 2], mine[:, 0]))])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run covers after its first period, joined by one space."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def _chunks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts, row by row, in lists of about CHUNK words."""
    rows, held = [], 0
    for text in texts:
        words = (text.as_py() or b"").split()
        if rows and held + len(words) > CHUNK:
            yield rows
            rows, held = [], 0
        rows.append(words)
        held += len(words)
    if rows:
        yield rows


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs``, every row and column, and n_words (long), runs (array of start, length, period) and collapsed (string).

    Words are separated by ASCII white space and numbered from 0. A run is a stretch with a smallest period q, at least
    max(``least_words``, 3 q) words long, that no neighbouring word extends; overlapping runs are all given, by start,
    then period. ``collapsed`` joins by one space the words that no run covers after its first q words. Null and blank
    texts have no words, no runs and the empty ``collapsed``. Each row is judged by itself, so ids, ties and repeated
    rows do not matter; a text is one task's work, with about 100 bytes a word. Columns of the three names are replaced.
    """
    shape = pa.struct(
        {
            "n_words": pa.int64(),
            "runs": pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()})),
            "collapsed": pa.string(),
        }
    )

    @arrow_udf(f"n_words long, runs {RUNS}, collapsed string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for rows in _chunks(texts):
                codes, _ = pd.factorize(np.array([w for words in rows for w in words] + [None], dtype=object)[:-1])
                parts = np.split(codes, np.cumsum([len(words) for words in rows])[:-1])
                for words, runs in zip(rows, runs_of(parts, least_words)):
                    listed = [dict(zip(("start", "length", "period"), row)) for row in runs.tolist()]
                    out.append({"n_words": len(words), "runs": listed, "collapsed": collapsed(words, runs).decode()})
            yield pa.array(out, shape)

    wide = docs.withColumn("_llm_runs", found(F.col(TEXT).cast("string").cast("binary")))
    for name in shape.names:
        wide = wide.withColumn(name, F.col(f"_llm_runs.{name}"))
    return wide.drop("_llm_runs")

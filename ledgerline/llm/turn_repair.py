"""Conversation structure repair: cheapest edits to a legal order of roles, found by divide and conquer.

Edits of one row are a step between four states of the legal order: nothing yet, after a system turn, after a user
turn, after an assistant turn. Steps of neighbouring rows compose, so slices of a long conversation are summed up by
themselves, states are dealt down from the conversation to its parts and slices, and each slice is repaired alone.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.llm.texts import TEXT
from ledgerline.sources.shared import written

CONV, TURN, ROLE = "conv_id", "turn", "role"

# Costs of edits, white space, and the ends of a whole sentence.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
STOPS = [".", "!", "?"]

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 30
#: Rows and characters of one slice.
SLICE_ROWS, SLICE_CHARS = 4096, 1 << 22

_LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_AFTER_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert at the end: a conversation ends as nothing or after an assistant turn.
CLOSING = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}

#: A row is a letter: s, u, a or o for the initial of its role (o: another), in upper case if truncated, x if it must go.
KINDS = "suaoSUAOx"


def _edits(kind: str) -> list[list[tuple[int, str]]]:
    """For each pair of states the least (cost, edits) of a row, with the turns inserted before it."""
    table = [[(FAR, "")] * 4 for _ in STATES]
    for state in STATES:
        now, before = state, ""
        for _ in range(3):  # two inserted turns reach every state that any number reaches
            options = [(now, DELETE, "D")]
            if kind != "x":
                extra = TRUNCATED if kind.isupper() else 0
                options.append((_AFTER_NEXT[now], REROLE + extra, "R"))
                if (now, kind.lower()) in _LEGAL:
                    options.append((_LEGAL[now, kind.lower()], extra, "K"))
            for to, cost, letter in options:
                edit = (cost + INSERT * len(before), before + letter)
                table[state][to] = min(table[state][to], edit)
            now, before = _AFTER_NEXT[now], before + "I"
    return table


EDITS = {kind: _edits(kind) for kind in KINDS}

# A step is a tuple of 16 (cost, order): by state before and after; ``order`` ranks the audits of one state before.
# A vector is a tuple of 4 (cost, order): the cheapest way to each state, and the rank of its audit among the four.
# Audits of ways to different states always differ, and none begins another (they end in the edit of the same row), so
# the least of the audits that follow a crossing never matters to which crossing is least.


def _ordered(costs_and_keys) -> tuple:
    keys = sorted({key for cost, key in costs_and_keys if cost < FAR})
    return tuple((cost, keys.index(key)) if cost < FAR else (FAR, 0) for cost, key in costs_and_keys)


STEPS = {kind: tuple(x for row in EDITS[kind] for x in _ordered(row)) for kind in KINDS}
AT = {state: tuple((0, 0) if state == s else (FAR, 0) for s in STATES) for state in STATES}


@lru_cache(maxsize=1 << 16)
def forward(vector: tuple, step: tuple) -> tuple[int, tuple]:
    """(least cost, vector less that cost) after one more step."""
    reached = []
    for to in STATES:
        ways = ((vector[s][0] + step[4 * s + to][0], (vector[s][1], step[4 * s + to][1])) for s in STATES)
        reached.append(min(ways))
    least = min(cost for cost, _ in reached)
    return least, _ordered([(cost - least if cost < FAR else FAR, key) for cost, key in reached])


@lru_cache(maxsize=1 << 16)
def backward(step: tuple, costs: tuple) -> tuple:
    """Costs from the states before a step to the end, less the least of them."""
    reached = [min(step[4 * s + to][0] + costs[to] for to in STATES) for s in STATES]
    least = min(reached)
    return tuple(min(FAR, cost - least) for cost in reached)


def summed(steps) -> tuple:
    """One step in place of several."""
    whole = []
    for state in STATES:
        vector, cost = AT[state], 0
        for step in steps:
            more, vector = forward(vector, step)
            cost += more
        whole += [(c + cost, order) if c < FAR else (FAR, 0) for c, order in vector]
    return tuple(whole)


def last_state(steps) -> int:
    """The state in which the audit-least cheapest repair of a whole conversation ends, before closing turns."""
    vector = AT[START]
    for step in steps:
        vector = forward(vector, step)[1]
    return min(STATES, key=lambda s: (vector[s][0] + INSERT * len(CLOSING[s]), vector[s][1]))


def crossings(steps: list, start: int, end: int) -> list[int]:
    """The states between steps on the audit-least cheapest way from ``start`` to ``end``, both included.

    Hirschberg's method: costs forward from the start and backward from the end meet in the middle, the crossing of
    least total cost and then least audit is taken, and both halves are solved alike. Besides the steps, only the states are kept.
    """
    path = [start] * len(steps) + [end]
    open_ = [(0, len(steps))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector, costs = AT[path[low]], tuple(cost for cost, _ in AT[path[high]])
        for k in range(low, middle):
            vector = forward(vector, steps[k])[1]
        for k in range(high - 1, middle - 1, -1):
            costs = backward(steps[k], costs)
        path[middle] = min(STATES, key=lambda s: (vector[s][0] + costs[s], vector[s][1]))
        open_ += [(low, middle), (middle, high)]
    return path


def _repaired(kinds: str, start: int, end: int | None, closes: bool) -> tuple[tuple[str, ...], int]:
    """(edits of each row, and those that close the conversation if it ``closes``; cost). No ``end``: the best one."""
    steps = [STEPS[kind] for kind in kinds]
    end = last_state(steps) if end is None else end
    path = crossings(steps, start, end)
    found = [EDITS[kind][path[k]][path[k + 1]] for k, kind in enumerate(kinds)]
    closing = CLOSING[end] if closes else ""
    return (*(letters for _, letters in found), closing), sum(cost for cost, _ in found) + INSERT * len(closing)


_short = lru_cache(maxsize=1 << 15)(_repaired)


def repaired(kinds: str, start: int = START, end: int | None = None, closes: bool = True):
    """As ``_repaired``; of the many conversations of the same few rows only the first is worked out."""
    return (_short if len(kinds) <= 64 else _repaired)(kinds, start, end, closes)


def turns_after(edits, roles, texts, start: int) -> list[tuple[str, str]]:
    """The (role, text) that the edits of rows (a string each, roles and texts of those that may stay) leave."""
    state, said, row = start, [], 0
    for letters in edits:
        for letter in letters:
            if letter == "I":
                state = _AFTER_NEXT[state]
                said.append((_NAME[state], ""))
            elif letter == "R":
                state = _AFTER_NEXT[state]
                said.append((_NAME[state], texts[row]))
            elif letter == "K":
                state = _LEGAL[state, roles[row][:1]]
                said.append((roles[row], texts[row]))
        row += 1
    return said


def _said(turns) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def judged(turns: DataFrame) -> DataFrame:
    """One row for each different (conversation, turn, role, text): conv (text, empty for null), its ``copies`` and its fault.

    ``fault`` is the first of blank, duplicate and truncated, of the first copy; the other copies are duplicates. Equal
    rows are counted with map-side combining; what stands in several turns is found by one aggregate over 128-bit
    digests, and written, so that a sentence that fills a third of a conversation can be split in the join.
    """
    text = F.coalesce(F.col(TEXT).cast("string"), F.lit(" "))
    role = F.coalesce(F.col(ROLE).cast("string"), F.lit(" "))
    conv = F.coalesce(F.col(CONV).cast("long").cast("string"), F.lit(""))
    counted = (
        turns.select(conv.alias("conv"), F.col(TURN).cast("long").alias(TURN), role.alias(ROLE), text.alias(TEXT))
        .groupBy("conv", TURN, ROLE, TEXT)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("said", F.md5(F.concat(F.length(ROLE).cast("string"), F.lit(":"), ROLE, TEXT)))
    )
    place = F.struct(F.col(TURN).isNotNull().alias("known"), F.col(TURN))  # null turns come first
    repeated = (
        counted.groupBy("conv", "said").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    repeated = written(repeated.select("conv", "said", "earliest"), "turns-repeated")
    left = F.rtrim(F.col(TEXT), F.lit(SPACE))
    fault = (
        F.when(left == "", "blank")
        .when(place > F.col("earliest"), "duplicate")
        .when(~F.substring(left, -1, 1).isin(STOPS), "truncated")
    )
    return counted.join(repeated, ["conv", "said"], "left").select("conv", TURN, ROLE, TEXT, "copies", fault.alias("fault"))


SLICE = (
    f"conv string, part int, slice int, alone boolean, kinds string, roles array<string>, texts array<string>, "
    f"blank long, duplicate long, truncated long, illegal long, turns long, "
    f"first_turn long, last_turn long, first_initial string, last_initial string"
)
_COUNTS = ["blank", "duplicate", "truncated"]
_LEGAL_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}


class _Slice:
    """Neighbouring rows of one conversation as they are read."""

    def __init__(self, conv, number):
        self.row = {"conv": conv, "slice": number, "alone": False} | dict.fromkeys(_COUNTS, 0)
        self.row |= {"illegal": 0, "turns": 0, "first_turn": None, "last_turn": None, "first_initial": None, "last_initial": None}
        self.kinds, self.roles, self.texts, self.chars, self.seen = [], [], [], 0, False

    def add(self, turn, role, text, fault):
        row, initial = self.row, role[:1]
        if not self.seen:
            row |= {"first_turn": turn, "first_initial": initial}
        elif (row["last_initial"], initial) not in _LEGAL_PAIRS:
            row["illegal"] += 1
        if turn is not None and turn != row["last_turn"]:
            row["turns"] += 1
        if turn is not None and row["first_turn"] is None:
            row["first_turn"] = turn
        row |= {"last_turn": turn, "last_initial": initial}
        if fault:
            row[fault] += 1
        gone = fault in ("blank", "duplicate")
        kind = initial if initial in ("s", "u", "a") else "o"
        self.kinds.append("x" if gone else kind.upper() if fault else kind)
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.chars += 0 if gone else len(role) + len(text)
        self.seen = True

    def full(self):
        return len(self.kinds) >= SLICE_ROWS or self.chars >= SLICE_CHARS

    def done(self):
        return self.row | {"kinds": "".join(self.kinds), "roles": self.roles, "texts": self.texts}


def cut(rows: Iterator[tuple]) -> Iterator[dict]:
    """Slices of the rows (conv, turn, role, text, copies, fault) of one part, which come in order.

    A conversation that is one slice and touches neither end of the part is ``alone``.
    """
    held, inner = None, False
    for conv, turn, role, text, copies, fault in rows:
        if held is not None and conv != held.row["conv"]:
            held.row["alone"] = inner and held.row["slice"] == 0
            yield held.done()
            held, inner = _Slice(conv, 0), True
        held = held or _Slice(conv, 0)
        for copy in range(copies):
            if held.full():
                yield held.done()
                held = _Slice(conv, held.row["slice"] + 1)
            held.add(turn, role, text, fault if copy == 0 or fault == "blank" else "duplicate")
    if held is not None:
        yield held.done()


def slices(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` in order, as slices of SLICE: at most SLICE_ROWS rows and about SLICE_CHARS characters each.

    Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation spreads over many tasks.
    """
    order = ["conv", F.asc_nulls_first(TURN), ROLE, TEXT]
    shape = to_arrow_schema(StructType.fromDDL(SLICE))
    ordered = judged(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def sliced(batches):
        part = None

        def rows():
            nonlocal part
            for batch in batches:
                columns = [batch.column(name).to_pylist() for name in ("conv", TURN, ROLE, TEXT, "copies", "fault")]
                if batch.num_rows:
                    part = batch.column("part")[0].as_py()
                yield from zip(*columns)

        held = []
        for row in cut(rows()):
            held.append(row | {"part": part})
            if len(held) >= 1024 or row["kinds"][SLICE_ROWS // 4 :]:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        yield pa.RecordBatch.from_pylist(held, shape)

    return ordered.mapInArrow(sliced, SLICE)


def _flat(step: tuple) -> str:
    return ",".join(f"{cost}:{order}" for cost, order in step)


def _step(text: str) -> tuple:
    return tuple(tuple(map(int, pair.split(":"))) for pair in text.split(","))


def _dealt(steps: list[tuple], start: int, end: int) -> tuple[list[int], list[int]]:
    path = crossings(steps, start, end)
    return path[:-1], path[1:]


def states(cut_up: DataFrame) -> DataFrame:
    """conv, part, slice, from_state, to_state, last of the slices that are not alone.

    Slices are summed up to parts and parts to conversations; states come down the same way. No task
    holds more than the slices of one part or the parts of one conversation, 16 small numbers each.
    """

    @pandas_udf("string")
    def summary(kinds: pd.Series) -> pd.Series:
        return pd.Series([_flat(summed([STEPS[k] for k in row])) for row in kinds], dtype=object)

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        whole = _flat(summed([_step(x) for x in rows["step"]]))
        return pd.DataFrame({"conv": rows["conv"][:1], "part": rows["part"][:1], "step": [whole], "slices": [len(rows)]})

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        steps = [_step(x) for x in rows["step"]]
        before, after = _dealt(steps, START, last_state(steps))
        closing = [False] * (len(rows) - 1) + [True]
        found = {"conv": rows["conv"], "part": rows["part"], "part_from": before, "part_to": after, "closing": closing}
        return pd.DataFrame(found)

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        first = rows.iloc[0]
        before, after = _dealt([_step(x) for x in rows["step"]], int(first["part_from"]), int(first["part_to"]))
        last = [False] * (len(rows) - 1) + [bool(first["closing"])]
        found = {"conv": rows["conv"], "part": rows["part"], "slice": rows["slice"]}
        return pd.DataFrame(found | {"from_state": before, "to_state": after, "last": last})

    steps = written(cut_up.where("not alone").select("conv", "part", "slice", summary("kinds").alias("step")), "turn-steps")
    parts = steps.groupBy("conv", "part").applyInPandas(up, "conv string, part int, step string, slices long")
    dealt = parts.groupBy("conv").applyInPandas(top, "conv string, part int, part_from int, part_to int, closing boolean")
    shape = "conv string, part int, slice int, from_state int, to_state int, last boolean"
    return steps.join(dealt, ["conv", "part"]).groupBy("conv", "part").applyInPandas(down, shape)


def repaired_slices(turns: DataFrame) -> DataFrame:
    """The slices of ``turns`` with audit, cost and ``repaired`` (array of role and text); written to the shared folder."""

    @pandas_udf("audit string, cost long, repaired array<struct<role:string,text:string>>")
    def mended(kinds: pd.Series, roles: pd.Series, texts: pd.Series, ends: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, role, text, start, end, closes in zip(kinds, roles, texts, ends["start"], ends["end"], ends["closes"]):
            edits, cost = repaired(kind, int(start), None if end < 0 else int(end), bool(closes))
            said = [{"role": r, "text": t} for r, t in turns_after(edits, role, text, int(start))]
            out.append(("".join(edits), cost, said))
        return pd.DataFrame(out, columns=["audit", "cost", "repaired"])

    def repaired_from(rows, start, end, closes):
        ends = F.struct(start.alias("start"), end.alias("end"), closes.alias("closes"))
        return rows.withColumn("_llm_mended", mended("kinds", "roles", "texts", ends)).select(
            "conv", "part", "slice", "alone", *_COUNTS, "illegal", "turns", "first_turn", "last_turn",
            "first_initial", "last_initial", "_llm_mended.*",
        )

    cut_up = written(slices(turns), "turn-slices")
    alone = repaired_from(cut_up.where("alone"), F.lit(START), F.lit(-1), F.lit(True))
    known = cut_up.where("not alone").join(states(cut_up), ["conv", "part", "slice"])
    return alone.unionByName(repaired_from(known, F.col("from_state"), F.col("to_state"), F.col("last")))


_REPORT = f"conv string, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(rows: Iterator[dict]) -> Iterator[dict]:
    """One report for each conversation from its slices, which come in order; texts are hashed and let go."""
    report = None
    for row in rows:
        if report is None or report["conv"] != row["conv"]:
            if report:
                yield _closed(report)
            report = {"conv": row["conv"], "audits": [], "hash": hashlib.sha256(), "empty": True, "turns": 0, "low": None, "last": None}
            report |= dict.fromkeys([*_COUNTS, "illegal", "cost"], 0)
        elif (report["initial"], row["first_initial"]) not in _LEGAL_PAIRS:
            report["illegal"] += 1
        for name in [*_COUNTS, "illegal", "cost", "turns"]:
            report[name] += row[name]
        if row["first_turn"] is not None and row["first_turn"] == report["last"]:
            report["turns"] -= 1
        if report["low"] is None:
            report["low"] = row["first_turn"]
        report["last"] = report["last"] if row["last_turn"] is None else row["last_turn"]
        report["initial"] = row["last_initial"]
        report["audits"].append(row["audit"])
        if row["repaired"]:
            said = _said((turn["role"], turn["text"]) for turn in row["repaired"])
            report["hash"].update((said if report["empty"] else "\n" + said).encode())
            report["empty"] = False
    if report:
        yield _closed(report)


def _closed(report: dict) -> dict:
    gaps = 0 if report["low"] is None else report["last"] - report["low"] + 1 - report["turns"]
    found = {name: report[name] for name in ("conv", *_COUNTS, "illegal", "cost")}
    return found | {"gaps": gaps, "audit": "".join(report["audits"]), "repaired_sha256": report["hash"].hexdigest()}


def conversation_reports(mended: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired_slices``: conv_id, gaps, faults, illegal, cost, audit, repaired_sha256.

    A conversation of one slice is its report; the slices of the others meet in order, one after the other, in
    one task, since a digest has no other form. It holds one slice's texts and the audit, a letter for each row.
    """
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    alone = mended.where("alone").select(
        "conv", gaps.alias("gaps"), *_COUNTS, "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256")
    )

    def folded(batches):
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        for report in _reports(rows):
            yield pa.RecordBatch.from_pylist([report], shape)

    shape = to_arrow_schema(StructType.fromDDL(_REPORT))
    open_ = mended.where("not alone").repartition("conv").sortWithinPartitions("conv", "part", "slice")
    both = alone.unionByName(open_.mapInArrow(folded, _REPORT))
    conv_id = F.when(F.col("conv") != "", F.col("conv").cast("long")).alias(CONV)
    return both.select(conv_id, *[c for c in both.columns if c != "conv"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of conversations with the columns conv_id, turn, role and text.

    Rows are ordered by turn, null first, and rows of one turn by role and text; equal rows are neighbours. A null role
    or text is one space. A null conv_id is a conversation of its own. Each row's first fault counts: blank (white space
    only), duplicate (role and text seen earlier in the conversation), truncated (the last other character is no stop).
    Roles must read as an optional system turn and then user and assistant turns in pairs, or nothing; they are known by
    their initials. Keeping a row is free, giving it another role costs 2, deleting it 3 (blank and duplicate rows must go),
    inserting a turn with an empty text 2, and a truncated row that stays 1. Of the cheapest repairs that with the least
    ``audit`` (the edits' initials) is taken. ``report`` has a row for each conversation: conv_id, gaps (missing numbers
    between its turns), blank, duplicate, truncated, illegal (neighbouring roles out of order), cost, audit and
    repaired_sha256 (of ``role:text`` lines). ``repaired turns`` has conv_id, place (a struct that grows with the order), role
    and text. Other columns are left behind, so their names cannot clash; empty tables give empty ones.
    """
    mended = written(repaired_slices(turns), "turns-repaired")
    conv_id = F.when(F.col("conv") != "", F.col("conv").cast("long")).alias(CONV)
    rows = mended.select(conv_id, "part", "slice", F.posexplode("repaired").alias("at", "said"))
    place = F.struct("part", "slice", "at").alias("place")
    return conversation_reports(mended), rows.select(CONV, place, "said.role", "said.text")

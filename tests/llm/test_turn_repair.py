import hashlib
import random
import zlib

import pytest

from ledgerline.llm import turn_repair as ops
from ledgerline.llm.queries import damaged_turns

SHAPE = "conv_id long, turn long, role string, text string, conv string, part string, audit string, fault string"
LEGAL = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """(role, text, fault) of rows in order, and how many neighbours are out of order."""
    seen, out = set(), []
    for role, text in rows:
        left = text.rstrip(ops.SPACE)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    pairs = zip(rows, rows[1:])
    return out, sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in pairs)


def best(rows, state="", at=0, memo=None):
    """The least (cost, audit, turns) for the rows from ``at`` on, by trying every edit."""
    memo = {} if memo is None else memo
    if (state, at) in memo:
        return memo[state, at]
    options = []
    for inserted in range(3):
        now, said = state, []
        for _ in range(inserted):
            now = NEXT[now]
            said.append((NAMES[now], ""))
        begun = (2 * inserted, "I" * inserted, tuple(said))
        if at == len(rows):
            if now in ("", "a"):
                options.append(begun)
            continue
        role, text, fault = rows[at]
        edits = [(now, 3, "D", ())]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            edits.append((NEXT[now], 2 + extra, "R", ((NAMES[NEXT[now]], text),)))
            if (now, role[:1]) in LEGAL:
                edits.append((LEGAL[now, role[:1]], 0 + extra, "K", ((role, text),)))
        for after, cost, letter, turn in edits:
            rest = best(rows, after, at + 1, memo)
            options.append((begun[0] + cost + rest[0], begun[1] + letter + rest[1], begun[2] + turn + rest[2]))
    memo[state, at] = min(options)
    return memo[state, at]


def plain(rows):
    """Reports by conversation, of rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, illegal = faults([r[1:] for r in own])
        cost, audit, said = best(judged)
        turns = {t for t, _, _ in own if t is not None}
        counts = [sum(f == name for _, _, f in judged) for name in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest, list(said))
    return out


def found(report, turns):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    said = {}
    for row in sorted(turns.collect(), key=lambda r: tuple(r["place"])):
        said.setdefault(row["conv_id"], []).append((row["role"], row["text"]))
    return {r["conv_id"]: (*(r[n] for n in names), said.get(r["conv_id"], [])) for r in report.collect()}


def conversation(rng, length):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usurper"]
    texts = ["Yes.", "No!", "why", "Why? ", "\t\n", "", None, "a.\x0b", "é"]
    return [(rng.choice([k, k, k + 1, None]), rng.choice(roles), rng.choice(texts)) for k in range(length)]


def table(spark, rows):
    return spark.createDataFrame([(*row, "?", "?", "?", "?") for row in rows], SHAPE)


def test_edges(spark):
    rng = random.Random(4)
    rows = [(c, *turn) for c in [*range(60), None, -5, 2**62 + 1] for turn in conversation(rng, rng.randint(1, 9))]
    rows += rows[:20] + [(500, None, None, None)] + [(501, 3, "assistant", "Same.")] * 40
    report, turns = ops.repair(table(spark, rows))
    assert found(report, turns) == plain(rows)
    assert turns.columns == ["conv_id", "place", "role", "text"]


def test_empty_table(spark):
    report, turns = ops.repair(table(spark, []))
    assert report.count() == 0 and turns.count() == 0


def test_long_conversations_over_slices_and_parts(spark):
    rng = random.Random(9)
    rows = [(c, *turn) for c in (1, 2, None) for turn in conversation(rng, 300)]
    rows += [(7, k, rng.choice(["user", "assistant", "tool"]), rng.choice([f"{k}.", f"{k}", "Same.", ""])) for k in range(13_000)]
    rows += [(8, 5, "user", "Again.")] * 9000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mended = ops.written(ops.repaired_slices(table(spark, rows)), "test")
        report = ops.conversation_reports(mended)
        own = mended.where("conv = '7'")
        assert own.select("part").distinct().count() > 1 and own.count() >= 4
        turns = mended.selectExpr("cast(nullif(conv, '') as long) conv_id", "part", "slice", "posexplode(repaired) (at, said)")
        turns = turns.selectExpr("conv_id", "struct(part, slice, at) place", "said.role", "said.text")
        result = found(report, turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    short = [r for r in rows if r[0] not in (7, 8)]
    assert {c: r for c, r in result.items() if c not in (7, 8)} == plain(short)
    own = sorted(r for r in rows if r[0] == 7)
    judged, illegal = faults([r[2:] for r in own])
    assert result[7][4:7] == (illegal, *walked(judged))
    assert result[8][:7] == (0, 0, 8999, 0, 8999, 2 + 3 * 8999, "K" + "D" * 8999 + "I")


def walked(rows):
    """(cost, audit) with costs to the end kept for every row, and the least edit taken that stays cheapest."""
    kinds = ["x" if f in ("blank", "duplicate") else (k.upper() if f else k) for k, f in ((r[:1] if r[:1] in tuple("sua") else "o", f) for r, _, f in rows)]
    to_end = [{s: 2 * len(ops.CLOSING[s]) for s in ops.STATES}]
    for kind in reversed(kinds):
        edits, after = ops.EDITS[kind], to_end[-1]
        to_end.append({s: min(edits[s][t][0] + after[t] for t in ops.STATES) for s in ops.STATES})
    to_end.reverse()
    state, audit = 0, ""
    for k, kind in enumerate(kinds):
        ways = [(ops.EDITS[kind][state][t][1], t) for t in ops.STATES if ops.EDITS[kind][state][t][0] + to_end[k + 1][t] == to_end[k][state]]
        letters, state = min(ways)
        audit += letters
    return to_end[0][0], audit + ops.CLOSING[state]


@pytest.mark.parametrize("seed", range(6))
def test_divide_and_conquer_equals_every_edit(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows, _ = faults([(r or " ", x or " ") for _, r, x in conversation(rng, rng.randint(0, 12))])
        kinds = "".join("x" if f in ("blank", "duplicate") else ((r[:1] if r[:1] in tuple("sua") else "o").upper() if f else (r[:1] if r[:1] in tuple("sua") else "o")) for r, _, f in rows)
        edits, cost = ops.repaired(kinds)
        said = ops.turns_after(edits, [r for r, _, _ in rows], [t for _, t, _ in rows], ops.START)
        assert (cost, "".join(edits), tuple(said)) == best(rows)


@pytest.mark.parametrize("seed", range(4))
def test_sums_of_slices_carry_costs_and_order(seed):
    rng = random.Random(seed)
    for _ in range(200):
        steps = [ops.STEPS[rng.choice(ops.KINDS)] for _ in range(rng.randint(1, 30))]
        cuts = sorted({0, len(steps), *(rng.randint(0, len(steps)) for _ in range(3))})
        parts = [steps[a:b] for a, b in zip(cuts, cuts[1:])]
        whole = ops.summed([ops.summed(part) for part in parts])
        assert whole == ops.summed(steps)
        end = ops.last_state(steps)
        path = ops.crossings([ops.summed(part) for part in parts], ops.START, end)
        joined = [s for k, part in enumerate(parts) for s in ops.crossings(part, path[k], path[k + 1])[: None if k == len(parts) - 1 else -1]]
        assert joined == ops.crossings(steps, ops.START, end)


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, None) for t in [*range(40), None] for r, x in [("assistant", "A. B! c?"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fate == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if fate == 2 else x
        want += [(c, t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged_turns(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

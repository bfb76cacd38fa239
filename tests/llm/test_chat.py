import random

import pytest

from ledgerline.llm.chat import CHATML, format_conversations, read_back


def turns(spark, rows):
    shape = "conv_id long, turn long, role string, text string, formatted string, segments string, valid string"
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], shape)


def result(spark, rows):
    formatted = format_conversations(turns(spark, rows))
    return {r["conv_id"]: r for r in read_back(formatted).collect()}, {r["conv_id"]: r for r in formatted.collect()}


def escaped(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def test_round_trip_of_any_text(spark):
    draw = random.Random(2)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "|", "<|", "a", "é😀", "assistant", "$1", "{0}"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "odd\nrole", "\\", "<|x"]), "".join(draw.choices(parts, k=draw.randint(0, 9)))) for c in range(60) for t in range(draw.randint(1, 7))]
    back, formatted = result(spark, rows)
    for conv in range(60):
        said = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == said
        assert back[conv]["loss_text"] == "".join(text for role, text in said if role == "assistant")
        assert back[conv]["formatted"].count("<|im_start|>") == back[conv]["formatted"].count("<|im_end|>") == len(said)
        at = 0
        for segment, (role, text) in zip(formatted[conv]["segments"], said):
            body = at + segment["head"]
            assert back[conv]["formatted"][body : body + segment["body"]] == escaped(text) and segment["loss"] == (role == "assistant")
            at = body + segment["body"] + segment["tail"]
        assert at == len(back[conv]["formatted"])


@pytest.mark.parametrize(
    "roles, valid",
    [
        ("ua", True), ("sua", True), ("uaua", True), ("u", False), ("a", False), ("au", False), ("uu a", False), ("ssua", False),
        ("usa", False), ("uaa", False), ("s", False), ("ux", False),
    ],
)
def test_order_of_roles(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool", " ": None}
    back, _ = result(spark, [(1, i, names[r], "t") for i, r in enumerate(roles)])
    assert back[1]["valid"] is valid and back[1]["n_turns"] == len(roles)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"),
        (2, 0, None, ""), (3, 0, "user", "x" * 300_000), (3, 1, "assistant", "<|" * 50_000),
    ]
    back, _ = result(spark, rows)
    assert [t["text"] for t in back[1]["turns"]] == ["", "a", "a", "b"] and back[1]["loss_text"] == "aab"
    assert back[2]["turns"][0].asDict() == {"role": "", "text": ""} and back[None]["turns"][0]["text"] == "no id"
    assert back[3]["loss_text"] == "<|" * 50_000 and back[3]["valid"]


def test_long_conversation_keeps_its_order(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1000)]
    random.Random(1).shuffle(rows)
    back, _ = result(spark, rows)
    assert [t["text"] for t in back[7]["turns"]] == [f"turn {t}" for t in range(1000)] and back[7]["valid"]


def test_empty_table_and_plan(spark):
    formatted = format_conversations(turns(spark, []))
    assert formatted.count() == 0
    plan = read_back(formatted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_template_is_data():
    assert CHATML.start.startswith(CHATML.control) and CHATML.end.startswith(CHATML.control)

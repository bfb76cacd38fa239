"""Chat formatting: a state machine over roles and a declarative template, DataFrame functions only."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are written and which order of roles is valid.

    ``start``, ``mid`` and ``end`` surround a turn as start role mid text end, and ``start`` and ``end`` are control
    strings that begin with ``control``. ``follows`` has the roles that may come after each role, None being
    the state before the first turn; a conversation may end after a role in ``final``. Text of
    ``loss_roles`` carries the loss.
    """

    control: str = "<|"
    start: str = "<|im_start|>"
    mid: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple = ("assistant",)
    final: tuple = ("assistant",)
    follows: dict = field(
        default_factory=lambda: {
            None: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


CHATML = Template()
TURNS_A_CHUNK = 64


def _escape(column, *strings):
    """A backslash before every backslash and in front of the last character of each string: reversible."""
    out = F.replace(column, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for string in strings:
        out = F.replace(out, F.lit(string), F.lit(string[:-1] + ESCAPE + string[-1]))
    return out


def unescape(column):
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def _may_follow(before, role, template: Template):
    """Whether ``role`` may come after ``before`` (null: the start of the conversation)."""
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        here = before.isNull() if state is None else before == state
        allowed = F.when(here, role.isin(*roles)).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Every turn as its formatted pieces: conv_id, turn, role, head, body, tail and loss (boolean, of the body)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit(template.start), _escape(role, template.control, template.mid), F.lit(template.mid))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        head.alias("head"),
        _escape(text, template.control).alias("body"),
        F.lit(template.end).alias("tail"),
        role.isin(*template.loss_roles).alias("loss"),
    )


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conv_id: formatted (string), segments (array, by turn), n_turns (long), valid (boolean).

    A segment has the code points of its ``head``, ``body`` and ``tail`` in ``formatted`` and ``loss``, whether the
    body counts. Turns are ordered by (turn, role, body), null first; ties and repeated rows each count as a
    turn. Null text and role are empty. ``valid`` says whether the state machine accepts the roles from first
    to last; a rejected conversation is formatted all the same. A null conv_id is a conversation of its own,
    and no turns give no rows. Other columns are ignored.

    A long conversation is first joined in chunks of TURNS_A_CHUNK turn numbers, so only its chunks meet.
    """
    turn = F.struct("turn", "role", "body", "head", "tail", "loss")
    chunked = (
        segments(turns, template)
        .groupBy("conv_id", F.floor(F.col("turn") / TURNS_A_CHUNK).alias("chunk"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    text = F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"]))
    shape = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.length(t["head"]).alias("head"),
            F.length(t["body"]).alias("body"),
            F.length(t["tail"]).alias("tail"),
            t["loss"].alias("loss"),
        ),
    )
    part = F.struct("chunk", F.array_join(text, "").alias("formatted"), shape.alias("turns"))
    whole = chunked.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
    ).select(
        "conv_id",
        "formatted",
        F.transform("turns", lambda t: t.dropFields("role")).alias("segments"),
        F.size("turns").cast("long").alias("n_turns"),
        _accepted("turns", template).alias("valid"),
    )


def _accepted(turns, template: Template):
    """Run the state machine over the roles; its state is the role before and whether all went well so far."""
    begin = F.struct(F.lit(None).cast("string").alias("before"), F.lit(True).alias("fine"))

    def step(state, t):
        fine = state["fine"] & _may_follow(state["before"], t["role"], template)
        return F.struct(t["role"].alias("before"), fine.alias("fine"))

    def end(state):
        return state["fine"] & F.coalesce(state["before"].isin(*template.final), F.lit(False))

    return F.aggregate(turns, begin, step, end)


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, formatted, n_turns, valid, turns (array of role, text) and loss_text, from the formatted text.

    The text is cut at the start strings, which escaping keeps out of texts, and unescaped; the flags of
    ``segments`` choose the bodies that make up ``loss_text``, in order and with nothing between.
    """
    blocks = F.filter(F.split("formatted", _literal(template.start), -1), lambda _, i: i > 0)
    head = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)" + _literal(template.mid)

    def parse(block):
        inner = F.substring(block, F.lit(1), F.length(block) - len(template.end))
        role = unescape(F.regexp_extract(inner, head, 1))
        return F.struct(role.alias("role"), unescape(F.regexp_replace(inner, head, "")).alias("text"))

    turns = formatted.withColumn("turns", F.transform(blocks, parse))
    marked = F.zip_with("turns", "segments", lambda t, s: F.when(s["loss"], t["text"]))
    return turns.select(
        "conv_id", "formatted", "n_turns", "valid", "turns", F.array_join(marked, "").alias("loss_text")
    )


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}" else c for c in text)

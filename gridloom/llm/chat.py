"""Chat formatting: a declarative template, a state machine over roles, segments with loss flags.

DataFrame operations only. A conversation is formatted as one string, so it is
the unit of work: its turns meet in one row, as the result demands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the state before the first turn.
START = "start"


@dataclass(frozen=True)
class Template:
    """Marks around each role's turns, which texts carry loss, and which role may follow which.

    Roles outside ``marks`` are written between the ``other`` marks with their
    name, so that any table can be formatted and read back. Every mark is a
    control string: it opens with ``<`` or ``[`` and never occurs inside an
    escaped text.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("<s>", "</s>"),
    })
    other: tuple[str, str, str] = ("[TURN]", "[SAYS]", "[/TURN]")
    loss: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })

    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def __post_init__(self):
        for c in self.controls():
            if c[0] not in "<[" or "\\" in c or len(c) < 2:
                raise ValueError(f"not a control string: {c!r}")
            if any(c[i:].startswith(d[0]) and c[i:].startswith(d[: len(c) - i]) for d in self.controls() for i in range(1, len(c))):
                raise ValueError(f"another control string can begin inside {c!r}")


def _groups(template: Template) -> dict[str, list[str]]:
    """What follows the first character of the control strings, by that character."""
    by: dict[str, list[str]] = {}
    for c in template.controls():
        by.setdefault(c[0], []).append(re.escape(c[1:]))
    return by


def _after_first(template: Template, taken: str) -> str:
    """``taken`` behind the first character of a control string, which may hold backslashes there."""
    return "|".join(rf"(?<={re.escape(k)}){taken}(?=\\*(?:{'|'.join(v)}))" for k, v in _groups(template).items())


def escape(text: Column, template: Template) -> Column:
    """Puts one backslash behind the first character of each control string, however many stand there already."""
    return F.regexp_replace(text, _after_first(template, ""), r"\\")


def unescape(text: Column, template: Template) -> Column:
    """Takes one backslash away again."""
    return F.regexp_replace(text, _after_first(template, r"\\"), "")


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, n_turns, segments, formatted, valid, first_bad.

    ``segments`` is an array of (text, loss): the marks, which never carry loss,
    and the escaped text of each turn; joined they give ``formatted``. ``valid``
    says whether the state machine accepts the order of roles, ``first_bad`` is
    the first turn (from 0) that it refuses, else null; refused conversations
    are formatted like the others. Order: by turn (null first), ties by role,
    then text. Null role and null text count as empty strings. Rows with a null
    conversation id form one conversation; repeated rows are turns of their
    own. Other columns are not read, whatever their names. An empty table gives
    no rows.
    """
    rows = turns.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"),
    )
    chats = rows.groupBy("_c").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    moves = F.create_map(*[F.lit(x) for a, after in template.order.items() for b in after for x in (f"{a}>{b}", b)])
    step = lambda s, t: F.struct(
        t["role"].alias("state"),
        F.when(s["bad"] >= 0, s["bad"]).when(F.element_at(moves, F.concat(s["state"], F.lit(">"), t["role"])).isNull(), s["n"]).otherwise(F.lit(-1)).alias("bad"),
        (s["n"] + 1).alias("n"),
    )
    state = F.aggregate("_t", F.struct(F.lit(START).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("n")), step)
    segments = F.flatten(F.transform("_t", lambda t: _segments(t, template)))
    return chats.select(
        F.col("_c").alias(conv),
        F.size("_t").cast("long").alias("n_turns"),
        segments.alias("segments"),
        state["bad"].alias("_bad"),
    ).select(
        conv, "n_turns", "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        (F.col("_bad") < 0).alias("valid"),
        F.when(F.col("_bad") >= 0, F.col("_bad")).alias("first_bad"),
    )


def _segments(t: Column, template: Template) -> Column:
    def part(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    body = escape(t["text"], template)
    name, says, end = (F.lit(x) for x in template.other)
    out = F.array(part(F.concat(name, escape(t["role"], template), says), False), part(body, False), part(end, False))
    for role, (before, after) in template.marks.items():
        own = F.array(part(F.lit(before), False), part(body, role in template.loss), part(F.lit(after), False))
        out = F.when(t["role"] == role, own).otherwise(out)
    return out


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) that a formatted conversation holds, texts as they were."""
    openers = [before for before, _ in template.marks.values()] + [template.other[0]]
    pieces = F.filter(F.split(formatted, f"(?={'|'.join(map(re.escape, openers))})"), lambda p: p != "")
    return F.transform(pieces, lambda p: _read(p, template))


def _read(piece: Column, template: Template) -> Column:
    def between(start: Column, end: str) -> Column:
        return F.substr(piece, start, F.length(piece) - start + 1 - len(end))

    name, says, end = template.other
    at = F.call_function("locate", F.lit(says), piece)
    out = F.struct(
        unescape(F.substr(piece, F.lit(len(name) + 1), at - 1 - len(name)), template).alias("role"),
        unescape(between(at + len(says), end), template).alias("text"),
    )
    for role, (before, after) in template.marks.items():
        own = F.struct(F.lit(role).alias("role"), unescape(between(F.lit(len(before) + 1), after), template).alias("text"))
        out = F.when(piece.startswith(before), own).otherwise(out)
    return out


def digests(chats: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """What formatted conversations hold, read from ``formatted`` and ``segments``.

    ``conv``, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars, loss_sha256 (all text under the loss flag, as it was),
    formatted_chars, valid.
    """
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    df = chats.select(
        conv, "valid",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted"), template).alias("_turns"),
        F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))).alias("_loss"),
    )
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        sha(F.concat_ws("", lines)).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        sha(F.col("_loss")).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )

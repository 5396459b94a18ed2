r"""Chat formatting: a template of roles, a state machine over turn order, and text segments with loss flags.

Native: one aggregation by conversation and built-in array functions.

``TEMPLATE`` marks every turn with an opening and a closing control string
and says whether its text counts for the loss. A text that holds something
like a control string gets one more backslash after that string's bracket
(``[INST]`` becomes ``[\INST]``, ``[\INST]`` becomes ``[\\INST]``), so a
formatted conversation holds a control string only where the template put
it, and removing one backslash restores the text.

Defined results: a null text or role is empty; turns with equal numbers are
ordered by role and text, null turns come first; a null conversation id is a
conversation of its own; a role that the template doesn't name is written
through ``OTHER``; every conversation is formatted, ``valid`` and ``bad_turn``
tell whether its turn order is right. Extra columns are not used. An empty
table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Turn(NamedTuple):
    opening: str
    closing: str
    loss: bool


TEMPLATE = {
    "system": Turn("[SYS] ", " [/SYS]", False),
    "user": Turn("[INST] ", " [/INST]", False),
    "assistant": Turn("[BOT] ", " </s>", True),
    "tool": Turn("[TOOL] ", " [/TOOL]", False),
}
OTHER = Turn("[ROLE] ", " [/ROLE]", False)  # the role's name stands before NAME_END
NAME_END = "[TEXT]"
BEGIN = "<s>"

_CONTROL = r"/?(?:SYS|INST|BOT|TOOL|ROLE|TEXT)\]|/?s>"
_ESCAPE = rf"([\[<])(\\*)({_CONTROL})"
_UNESCAPE = rf"([\[<])\\(\\*)({_CONTROL})"

# State machine: (state, role) -> next state; anything else is an error that stays.
TRANSITIONS = {
    ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
    ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant",
}
FINAL = ["assistant"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _by_role(role: Column, value, other) -> Column:
    out = None
    for name, turn in TEMPLATE.items():
        out = F.when(role == name, value(turn)) if out is None else out.when(role == name, value(turn))
    return out.otherwise(other)


def _segments(turns: Column) -> Column:
    def of(t: Column) -> Column:
        role = t["role"]
        opening = _by_role(role, lambda x: F.lit(x.opening), F.concat(F.lit(OTHER.opening), escape(role), F.lit(NAME_END)))
        closing = _by_role(role, lambda x: F.lit(x.closing), F.lit(OTHER.closing))
        def one(text, loss):
            return F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(one(opening, F.lit(False)), one(escape(t["text"]), _by_role(role, lambda x: F.lit(x.loss), F.lit(OTHER.loss))),
                       one(closing, F.lit(False)))

    begin = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    return F.concat(begin, F.flatten(F.transform(turns, of)))


def _order(turns: Column) -> Column:
    moves = F.create_map(*[F.lit(x) for (state, role), after in TRANSITIONS.items() for x in (f"{state}>{role}", after)])

    def step(at: Column, t: Column) -> Column:
        after = F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit(">"), t["role"])), F.lit("error"))
        return F.struct(after.alias("state"), (at["n"] + 1).alias("n"),
                        F.when((after == "error") & at["bad"].isNull(), at["n"]).otherwise(at["bad"]).alias("bad"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, begin, step)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``formatted``, ``segments`` (text, loss), ``valid``, ``bad_turn`` (position of the first turn out of order)."""
    plain = rows.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = turns.select("conv_id", _segments(F.col("turns")).alias("segments"), _order(F.col("turns")).alias("at"))
    return made.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments",
                       F.col("at.state").isin(FINAL).alias("valid"), F.col("at.bad").alias("bad_turn"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss)."""
    known = [*TEMPLATE.items(), (None, OTHER)]
    starts = "|".join(rf"\[{t.opening.strip()[1:-1]}\]" for _, t in known)
    parts = F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), f"(?={starts})", -1), lambda p: p != "")

    def of(p: Column) -> Column:
        out = None
        for name, t in known:
            inner = F.substr(p, F.lit(len(t.opening) + 1), F.length(p) - len(t.opening) - len(t.closing))
            if name is None:
                role, body = F.substring_index(inner, NAME_END, 1), F.substr(inner, F.length(F.substring_index(inner, NAME_END, 1)) + len(NAME_END) + 1)
            else:
                role, body = F.lit(name), inner
            row = F.struct(unescape(role).alias("role"), unescape(body).alias("text"), F.lit(t.loss).alias("loss"))
            out = F.when(p.startswith(t.opening), row) if out is None else out.when(p.startswith(t.opening), row)
        return out

    return F.transform(parts, of)

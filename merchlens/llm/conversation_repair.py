"""Conversation structure repair: cheapest edits that give a conversation legal turns, by an auction.

Edits: Keep costs nothing, Rerole (to user or assistant) 3, Delete 4, Insert (an
empty user or assistant turn) 3; a truncated turn that isn't deleted adds 3;
blank turns and duplicates must be deleted. The initials of the roles that
result are ``(s?(ua)+)?``.

The lattice. Node (column i, state s) means: the first i turns are edited, and
the turns kept end in state s (nothing yet, system, user, assistant). Arcs are
edits; Inserts stay in a column. Costs are whole numbers, and every cycle costs
more than nothing.

The auction. Every node has a price, at most the cost of any arc plus the price
at its other end. From an origin a path is built: if its last node's price is
below the cheapest arc plus the price there, the price rises to it and the path
is contracted by a node; else the path is extended along that arc. A path that
meets a node whose price has converged ends there, and all its prices have
converged too, since its arcs are tight. Origins are taken column by column from
the last; a column starts from the least price of the next one, which keeps all
prices feasible and rises few. So the work grows with the length of the conversation.
All prices then equal the cost of the cheapest way on, so exactly the
tight arcs (price = cost + price behind) lie on cheapest ways; an edit's letter
fixes the state that follows, so the tight arc of the least letter, again and
again, traces the ASCII-least audit.

Rows go to their conversation by one shuffle and are sorted there; a task holds
one conversation at a time (its result is one row).

Defined results: null roles and texts count as one space; turns are ordered by
turn (nulls first), role and text; repeated rows are turns of their own (the later
ones are duplicates); rows whose ``present`` isn't true only name their
conversation; a conversation without turns has zeros, an empty audit and no
repaired turns; null ids form a conversation; no rows in, no rows out.
Input columns other than those named are not used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.llm.shared import small_batches

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\v\f\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # state after a user or assistant turn, whichever may follow a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
SHARED_TURNS = 64  # audits of conversations up to this length are shared by those of equal kinds of turns

REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


class Kind(NamedTuple):
    """What the edits of a turn depend on."""

    initial: str  # s, u, a, or "" for any other role
    gone: bool  # must be deleted
    truncated: bool


@lru_cache(maxsize=None)
def _arcs(kind: Kind | None) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """By state: (letter, cost, columns on, next state) in the order of letters; ``None``: behind the last turn."""
    out = []
    for state in range(4):
        arcs = [("I", INSERT, 0, NEXT[state])]
        if kind:
            more = TRUNCATED if kind.truncated else 0
            arcs.append(("D", DELETE, 1, state))
            if not kind.gone:
                arcs.append(("R", REROLE + more, 1, NEXT[state]))
                if kind.initial == ROLE[NEXT[state]][0]:
                    arcs.append(("K", more, 1, NEXT[state]))
                elif kind.initial == "s" and state == START:
                    arcs.append(("K", more, 1, SYSTEM))
        out.append(tuple(sorted(arcs)))
    return tuple(out)


def prices(kinds: tuple[Kind, ...]) -> list[int]:
    """Converged prices of the nodes 4 * column + state; the last is the destination's, 0."""
    end = 4 * (len(kinds) + 1)
    price, converged = [0] * (end + 1), bytearray(end + 1)
    converged[end] = 1
    for column in range(len(kinds), -1, -1):
        base = 4 * column
        if column < len(kinds):
            price[base:base + 4] = [min(price[base + 4:base + 8])] * 4
            arcs = [[(cost, base + 4 * on + to) for _, cost, on, to in of] for of in _arcs(kinds[column])]
        else:
            arcs = [[(cost, base + to) for _, cost, _, to in of] for of in _arcs(None)]
            for state in (START, ASSISTANT):
                arcs[state].append((0, end))
        for origin in range(base, base + 4):
            path = [origin]
            while not converged[path[-1]]:  # never leaves the column: all behind has converged
                at = path[-1]
                best, to = min((cost + price[to], to) for cost, to in arcs[at - base])
                if price[at] == best:
                    path.append(to)  # extension
                else:
                    price[at] = best
                    if at != origin:
                        path.pop()  # contraction
            for node in path:
                converged[node] = 1
    return price


def audit(kinds: tuple[Kind, ...]) -> tuple[int, str]:
    """Least cost and its ASCII-least edits."""
    price, column, state, out = prices(kinds), 0, START, []
    while price[4 * column + state]:
        at = 4 * column + state
        for letter, cost, on, to in _arcs(kinds[column] if column < len(kinds) else None)[state]:
            if price[at] == cost + price[at + 4 * on + to - state]:
                out.append(letter)
                column, state = column + on, to
                break
    while column < len(kinds):  # what is left costs nothing: all of it is kept
        out.append("K")
        column += 1
    return price[0], "".join(out)


_shared_audit = lru_cache(maxsize=100_000)(audit)


def fault(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    """The first fault of a turn (or "") among those ``seen``, to which it is added."""
    body = text.rstrip(SPACE)
    again = (role, text) in seen
    seen.add((role, text))
    return "blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ENDS else ""


def repair(turns: list[tuple[int | None, str, str]]) -> dict:
    """Counts, cost, audit and repaired turns of a conversation's (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    faults = [fault(role, text, seen) for _, role, text in turns]
    kinds = tuple(Kind(role[:1] if role[:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(turns, faults, strict=True))
    cost, edits = (_shared_audit if len(kinds) <= SHARED_TURNS else audit)(kinds)
    numbers = {t for t, _, _ in turns if t is not None}
    repaired, state, at = [], START, 0
    for letter in edits:
        if letter == "D":
            at += 1
            continue
        state = SYSTEM if letter == "K" and kinds[at].initial == "s" else NEXT[state]
        if letter == "I":
            repaired.append({"role": ROLE[state], "text": ""})
        else:
            repaired.append({"role": turns[at][1] if letter == "K" else ROLE[state], "text": turns[at][2]})
            at += 1
    return {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(x[1][:1] + y[1][:1] not in LEGAL for x, y in zip(turns, turns[1:], strict=False)), "cost": cost, "audit": edits, "repaired": repaired}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose rows follow each other, also across batches."""
    def out(ids: list, found: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(ids, kind), *(pa.array([f[c] for f in found], pa.int64()) for c in COUNTS), pa.array([f["audit"] for f in found]), pa.array([f["repaired"] for f in found], REPAIRED)]
        return pa.RecordBatch.from_arrays(columns, names=["id", *COUNTS, "audit", "repaired"])

    held, turns, kind = (), [], None
    for batch in batches:
        kind, ids, found = batch.column(0).type, [], []
        for id, present, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held != (id,):
                if held:
                    ids.append(held[0])
                    found.append(repair(turns))
                held, turns = (id,), []
            if present:
                turns.append((turn, role, text))
        if ids:
            yield out(ids, found, kind)
    if held:
        yield out([held[0]], [repair(turns)], kind)


def repair_conversations(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Per conversation: id, ``gaps`` in the turn numbers, ``blank``, ``duplicate``, ``truncated`` turns, ``illegal`` neighbours,
    ``cost``, ``audit`` (initials of the edits) and ``repaired`` (array of role and text)."""
    small_batches(rows.sparkSession)
    used = rows.select(F.col(id).alias("id"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"), F.col(turn).cast("bigint").alias("turn"),
                       *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    sorted_rows = used.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    made = sorted_rows.mapInArrow(_conversations, f"id {dict(used.dtypes)['id']}, {counts}, audit string, repaired array<struct<role: string, text: string>>")
    return made.withColumnRenamed("id", id)

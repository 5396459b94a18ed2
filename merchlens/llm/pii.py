"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

A recogniser is a row of data: kind, pattern, check, prior. Its pattern proposes
leftmost spans that don't overlap, its check (digit counts, octets, Luhn, mod-97,
reserved numbers) drops those that can't be real, and the score is the prior, plus
``BONUS`` if a word that speaks for the kind stands within ``NEAR`` characters,
minus ``BONUS`` if one that speaks against it does.

Base recognisers keep all their confirmed spans: their score is at least
``ACCEPT``. The others must reach ``ACCEPT``, must not touch letters or digits on
either side, and give way to base spans and to confirmed and accepted spans of recognisers before
them that they overlap. They find what the base patterns swallow or don't cover:
cards and phone numbers next to other digits, shorter card numbers, phone numbers
without a country code, account numbers (IBAN) and social security numbers.

Patterns are searched in time linear in the text: e-mail addresses are grown
from their "@", the digit patterns from runs of digits, and texts without digits
or "@" aren't searched at all. Offsets count code points, ends are exclusive.

Defined results: null texts are empty and hold no spans; repeated rows keep
their rows; all input columns stay, but one of the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.shared import small_batches

ACCEPT, BONUS, NEAR = 50, 30, 40  # scores are per cent
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# Words (lower-case) that speak for or against a kind.
FOR = {
    "card": ("card", "credit", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "anrufen", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "ip": ("ip", "host", "server", "address"),
    "email": ("email", "mail", "contact"),
}
AGAINST = {
    "card": ("order", "invoice", "isbn", "serial", "tracking"),
    "phone": ("order", "invoice", "isbn", "serial", "tracking"),
    "iban": ("serial", "tracking"),
    "ssn": ("order", "invoice", "part", "serial", "tracking"),
    "ip": ("version", "release"),
    "email": (),
}
_FOR, _AGAINST = ({k: frozenset(v) for k, v in of.items()} for of in (FOR, AGAINST))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[a-z\x80-\U0010FFFF]+")


def digits_of(span: str) -> str:
    return re.sub(r"[^0-9]", "", span)


def luhn(digits: str) -> bool:
    """Sum of the digits, every second from the right doubled (over 9: less 9), divides by ten."""
    twice = (2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def mod97(span: str) -> bool:
    """An account number, its first four characters moved behind and letters read as 10 to 35, leaves 1 over 97; it has 15 to 34 characters."""
    account, rest = span.replace(" ", ""), 0
    for c in account[4:] + account[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1 and 15 <= len(account) <= 34


def octets(span: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in span.split(".")))


def _social(span: str) -> bool:
    return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from their "@"."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start, found = low + len(before.rstrip(_LOCAL)), _DOMAIN.match(text, at)
        low = at + 1
        if start < at and found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", low)


_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # also without a point, so that a long run of digits is passed at once


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``: each four parts of a dotted chain."""
    for chain in _CHAIN.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i:i + 4])) + 3
            yield at, at + size
            at += size + 1


def _pattern(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    search = re.compile(pattern).finditer
    return lambda text: (m.span() for m in search(text))


class Recogniser(NamedTuple):
    kind: str
    spans: Callable[[str], Iterator[tuple[int, int]]]
    confirmed: Callable[[str], bool]
    prior: int
    base: bool = False


def _card(low: int, high: int) -> Callable[[str], bool]:
    return lambda span: low <= len(d := digits_of(span)) <= high and luhn(d)


# Base recognisers first; one pattern never backtracks over more than a run of its own characters.
RECOGNISERS = (
    Recogniser("email", emails, lambda span: True, 70, True),
    Recogniser("ip", addresses, octets, 60, True),
    Recogniser("card", _pattern(r"[0-9](?:[ -]?[0-9])+"), _card(16, 19), 80, True),
    Recogniser("phone", _pattern(r"\+[0-9][ ().0-9-]+[0-9]"), lambda span: 8 <= len(digits_of(span)) <= 15, 60, True),
    Recogniser("iban", _pattern(r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}"), mod97, 80),
    Recogniser("card", _pattern(r"[0-9]+"), _card(16, 19), 50),
    Recogniser("card", _pattern(r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"), _card(16, 16), 50),
    Recogniser("card", _pattern(r"[0-9]+"), _card(13, 15), 30),
    Recogniser("phone", _pattern(r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"), lambda span: True, 50),
    Recogniser("phone", _pattern(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), lambda span: True, 30),
    Recogniser("ssn", _pattern(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _social, 30),
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: int
    base: bool


def score(text: str, kind: str, start: int, end: int, prior: int) -> int:
    """The prior adjusted by the words near a span."""
    words = {w for part in (text[max(0, start - NEAR):start], text[end:end + NEAR]) for w in _WORD.findall(part.translate(_ASCII_LOWER))}
    return prior + BONUS * (not _FOR[kind].isdisjoint(words)) - BONUS * (not _AGAINST[kind].isdisjoint(words))


def _overlaps(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[bool]:
    """Whether each span of ``one`` (by start) overlaps any of ``other``."""
    out, i, other, reach = [], 0, sorted(other), 0
    for start, end in one:
        while i < len(other) and other[i][0] < end:
            reach = max(reach, other[i][1])
            i += 1
        out.append(reach > start)
    return out


def find_pii(text: str) -> list[Span]:
    """Spans by kind, then start."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for r in RECOGNISERS:
        found = [(s, e) for s, e in r.spans(text) if r.confirmed(text[s:e])]
        if not r.base:
            found = [(s, e) for s, e in found if not ((s and text[s - 1].isascii() and text[s - 1].isalnum()) or (e < len(text) and text[e].isascii() and text[e].isalnum()))]
        scored = [Span(r.kind, s, e, score(text, r.kind, s, e, r.prior), r.base) for s, e in found]
        if r.base:
            scored = [x._replace(score=max(ACCEPT, x.score)) for x in scored]
            taken += found
            out += scored
            continue
        scored = [x for x in scored if x.score >= ACCEPT]
        out += [x for x, hit in zip(scored, _overlaps([x[1:3] for x in scored], taken), strict=True) if not hit]
        taken += [x[1:3] for x in scored]
    return sorted(out, key=lambda x: (KINDS.index(x.kind), x.start, x.end))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int64()), ("base", pa.bool_())]))


def _pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, "[0-9@]")).to_pylist():
            found[i] = [x._asdict() for x in find_pii(texts[i].as_py())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, SPANS)], names=[*batch.schema.names[:-1], "spans"])


def personal_data(docs: DataFrame, text: str = "text", column: str = "pii") -> DataFrame:
    """``docs`` with ``column``: array of (kind, start, end, score in per cent, base)."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("t", F.col(f"c{names.index(text)}"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    made = plain.mapInArrow(_pass, f"{schema}, spans array<struct<kind: string, start: bigint, end: bigint, score: bigint, base: boolean>>")
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != column]
    return made.select(*kept, F.col("spans").alias(column))

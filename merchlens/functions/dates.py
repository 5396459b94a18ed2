"""Date, time and rounding expressions with warehouse semantics.

All helpers return Catalyst ``Column`` expressions (no UDFs), so they stay
inside whole-stage codegen and, where they compare a raw column with a
literal, can still be pushed to the parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_iso_date(value) -> bool:
    return isinstance(value, str) and len(value) == 10 and value[4] == "-" and value[7] == "-" \
        and value.replace("-", "").isdigit()


def _date_or_col(value: str | Column | dt.date) -> Column:
    """A date given as a literal (``date`` or ``'YYYY-MM-DD'``) or a column (name or ``Column``)."""
    if isinstance(value, dt.date) or _is_iso_date(value):
        return lit_date(value)
    return _col(value)


def lit_date(value: str | dt.date) -> Column:
    """A DATE literal from ``'YYYY-MM-DD'`` or a ``datetime.date``."""
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def lit_ts(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (warehouse timestamps carry no zone)."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return F.lit(value).cast("timestamp_ntz")


def month_start(c: str | Column) -> Column:
    """First day of the month as a DATE (``DATE(DATE_TRUNC(x, MONTH))``)."""
    return F.trunc(_col(c).cast("date"), "month")


def complete_months(c: str | Column, as_of: str | dt.date) -> Column:
    """The row's month started before the month of ``as_of``.

    ``month_start(d) < month_start(as_of)`` is the same as ``d < month_start(as_of)``
    for a date ``d``; the second form compares the raw column with a literal,
    which the parquet reader can use to skip row groups.
    """
    return _col(c) < F.trunc(lit_date(as_of), "month")


def month_boundaries_between(start: str | Column, end: str | Column | dt.date) -> Column:
    """Number of calendar-month boundaries from ``start`` to ``end``.

    Jan 31 -> Feb 1 is one month, as in warehouse ``DATE_DIFF(end, start, MONTH)``;
    Spark's ``months_between`` would give a fraction and ``datediff(MONTH)``
    counts whole months, so year/month arithmetic is used instead.
    """
    s = _col(start)
    e = _date_or_col(end)
    return ((F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))).cast("bigint")


def days_between(start: str | Column, end: str | Column | dt.date) -> Column:
    """``DATE_DIFF(end, start, DAY)`` on the date parts."""
    return F.datediff(_date_or_col(end), _col(start).cast("date"))


def seconds_of_day(c: str | Column) -> Column:
    """Whole seconds since midnight; fractions of a second are dropped."""
    ts = _col(c)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def time_of_day_diff_seconds(end: str | Column, start: str | Column) -> Column:
    """S3: ``TIME_DIFF(TIME(end), TIME(start), SECOND)``.

    Subtracts times of day, so a span that crosses midnight is negative
    (23:59:50 -> 00:00:10 gives -86,380) and only whole-second boundaries count.
    """
    return seconds_of_day(end) - seconds_of_day(start)


def round_half_away_to_long(c: str | Column) -> Column:
    """``CAST(x AS INT64)`` of the warehouse, which rounds half away from zero.

    A plain Spark cast truncates (1.5 -> 1); ``round`` uses HALF_UP, which on
    the magnitude is half away from zero.
    """
    return F.round(_col(c)).cast("bigint")


def period_flags(ts: str | Column, as_of: str | dt.datetime) -> dict[str, Column]:
    """Elapsed-in-period and same-period flags for month, quarter and year.

    ``is_in_<p>_to_date_range``: time elapsed since the start of the row's period
    is strictly less than the time elapsed since the start of the current
    period (``as_of``). ``is_current_<p>``: same period as ``as_of``.
    """
    t = _col(ts).cast("timestamp_ntz")
    now = lit_ts(as_of) if isinstance(as_of, (str, dt.datetime)) else _col(as_of)
    flags = {}
    for unit in ("month", "quarter", "year"):
        row_start = F.date_trunc(unit, t).cast("timestamp_ntz")
        now_start = F.date_trunc(unit, now).cast("timestamp_ntz")
        flags[f"is_in_{unit}_to_date_range"] = (t - row_start) < (now - now_start)
    for unit in ("month", "quarter", "year"):
        flags[f"is_current_{unit}"] = (F.date_trunc(unit, t).cast("timestamp_ntz")
                                       == F.date_trunc(unit, now).cast("timestamp_ntz"))
    return flags

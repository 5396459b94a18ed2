"""Range joins by time buckets, for conditions that no minimum can replace.

A join on a key and a range of time (``created_at`` within some days before a
campaign) pairs all of a key's rows before the range is tested, and a hot key
lands in one task. Here time is cut into buckets as wide as the range: a row of
the left side meets only the one or two buckets that its range touches, by an
equality join on (key, bucket), so a key's work is spread over its buckets and grows
with the pairs that lie near each other in time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = "_time_bucket"


def _seconds(c) -> F.Column:
    return F.unix_seconds(c.cast("timestamp"))


def banded_range_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, before: dt.timedelta,
                      how: str = "inner") -> DataFrame:
    """Pairs with equal ``on`` and ``left_time - before <= right_time < left_time``.

    ``on`` occurs once in the result; other columns of the two must differ in name. ``how``: inner, or left_semi (rows of ``left``
    with a partner, once each).
    """
    width = int(before.total_seconds())
    if width <= 0:
        raise ValueError("the range must be longer than nothing")
    at = F.floor(_seconds(F.col(left_time)) / width)
    # The range [t - width, t) touches the bucket of t and the one before it.
    spread = left.withColumn(BUCKET, F.explode(F.array(at - 1, at)))
    dealt = right.withColumn(BUCKET, F.floor(_seconds(F.col(right_time)) / width))
    l, r = spread.alias("l"), dealt.alias("r")
    first, last = F.col(f"l.{left_time}") - F.expr(f"INTERVAL {width} SECONDS"), F.col(f"l.{left_time}")
    near = (F.col(f"l.{on}") == F.col(f"r.{on}")) & (F.col(f"l.{BUCKET}") == F.col(f"r.{BUCKET}")) \
        & (F.col(f"r.{right_time}") >= first) & (F.col(f"r.{right_time}") < last)
    if how == "left_semi":
        # A row may have partners in both of its buckets: it is told apart by its own columns, and repeated rows are counted.
        counted = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_copies"))
        spread = counted.withColumn(BUCKET, F.explode(F.array(at - 1, at))).alias("l")
        met = spread.join(r, near, "left_semi").select(*left.columns, "_copies").distinct()
        return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*left.columns)
    return l.join(r, near, how).select("l.*", *[f"r.{c}" for c in right.columns if c != on]).drop(BUCKET)


def recent_counts(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, before: dt.timedelta, out: str) -> DataFrame:
    """Distinct (key, time) of ``left`` with the number of rows of ``right`` in the range before it (zero if none).

    Rows of ``right`` are counted by (key, time) first, and sums are formed within a bucket, so a hot key's pairs are never kept.
    """
    asked = left.select(on, left_time).distinct()
    counted = right.groupBy(on, right_time).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = banded_range_join(asked, counted, on, left_time, right_time, before)
    sums = pairs.groupBy(on, left_time).agg(F.sum("_rows").alias(out))
    return asked.join(sums, [on, left_time], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))

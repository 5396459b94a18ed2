"""Exact distinct counts that roll up, by bitmaps over dictionary ids.

Counts of distinct members can't be added up over days or campaigns. A bitmap
of members can be merged: every value gets a dense number once (the
dictionary), a group's values become bitmaps of 32,768 numbers each (4 KB, only those that
hold any), merging is a bitwise OR and counting a bit count. So counts
of any coarser level come from the finer level's bitmaps without the members,
and are exact. Groups that hold few of many values have bitmaps of 64 numbers instead: else each value would cost 4 KB.

The dictionary is numbered without a global sort: values are dealt to
``SLOTS`` by their hash, numbered within each, and shifted by the sizes of the
slots before; only ``SLOTS`` sums meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SLOTS = 4096
BUCKET, BITMAP = "bitmap_bucket", "bitmap"


def dictionary(values: DataFrame, value: str, id: str = "value_id") -> DataFrame:
    """Distinct non-null values of a column with dense numbers from 0, by (hash slot, value)."""
    slot = F.pmod(F.xxhash64(value), F.lit(SLOTS))
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct().withColumn("_slot", slot)
    sizes = distinct.groupBy("_slot").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_slot", before.alias("_before"))  # one row a slot
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(value))
    numbered = distinct.withColumn("_place", place).join(F.broadcast(shifts), "_slot")
    return numbered.select(value, (F.col("_before") + F.col("_place") - 1).alias(id))


def value_bitmaps(df: DataFrame, groups: Sequence[str], id: str, condition: Column | None = None, *, sparse: bool = False) -> DataFrame:
    """Bitmaps of the ids of each group: (groups, bucket, bitmap). ``sparse``: bitmaps of 64 numbers, one BIGINT each, for groups that hold
    few of many values: a group then never has more bytes than its rows."""
    rows = (df if condition is None else df.where(condition)).where(F.col(id).isNotNull())
    if sparse:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(id).bitwiseAND(F.lit(63)).cast("int"))
        return rows.groupBy(*groups, F.shiftright(F.col(id).cast("bigint"), 6).alias(BUCKET)).agg(F.bit_or(bit).alias(BITMAP))
    at = F.col(id) + 1  # Spark numbers positions from 1
    return (rows.groupBy(*groups, F.bitmap_bucket_number(at).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(BITMAP)))


def _is_sparse(bitmaps: DataFrame) -> bool:
    return bitmaps.schema[BITMAP].dataType == T.LongType()


def merged_bitmaps(bitmaps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The bitmaps of a coarser level: each group's union."""
    union = F.bit_or if _is_sparse(bitmaps) else F.bitmap_or_agg
    return bitmaps.groupBy(*groups, BUCKET).agg(union(BITMAP).alias(BITMAP))


def bitmap_counts(bitmaps: DataFrame, groups: Sequence[str], out: str) -> DataFrame:
    """Distinct values of each group, from bitmaps at its own level (one row a group and bucket)."""
    bits = F.bit_count(BITMAP).cast("bigint") if _is_sparse(bitmaps) else F.bitmap_count(BITMAP)
    return bitmaps.groupBy(*groups).agg(F.sum(bits).alias(out))

"""Joins whose hot keys are salted, where adaptive splitting can't act.

Adaptive execution splits a skewed partition of a join, but not if an
aggregation follows that uses the join's partitioning. ``salted_join`` finds the hot keys of the fact (those
with more than a share of all rows; at most 1 / share of them), deals their
rows to ``salts`` partitions and repeats the dimension's rows of those keys
alone that often. The result is that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def hot_keys(fact: DataFrame, on: str, share: float) -> list:
    """Keys with more than ``share`` of the rows (fewer than 1 / share, so they may come to the driver)."""
    counts = fact.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    total = fact.count()
    return [r[0] for r in counts.where((F.col("n") > share * total) & F.col(on).isNotNull()).select(on).collect()]


def salted_join(fact: DataFrame, dim: DataFrame, on: str, how: str = "left", *, salts: int = 16, share: float = 0.01, hot: list | None = None) -> DataFrame:
    """``fact.join(dim, on, how)`` (left or inner) with the rows of hot keys, and of the null key, spread over ``salts`` values.

    Rows of a key are spread by their other columns (rows that are equal throughout stay together: sum them up first).
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how: {how}")
    hot = hot_keys(fact, on, share) if hot is None else list(hot)
    is_hot = F.col(on).isin(hot) if hot else F.lit(False)
    zero = F.lit(0).cast("bigint")
    # A row's salt depends on its columns alone, so that a task run again deals it alike.
    by = F.pmod(F.xxhash64(*fact.columns), F.lit(salts))
    salted = fact.withColumn(SALT, F.when(is_hot | F.col(on).isNull(), by).otherwise(zero))
    copies = F.when(is_hot, F.sequence(zero, zero + (salts - 1))).otherwise(F.array(zero))
    repeated = dim.where(F.col(on).isNotNull()).withColumn(SALT, F.explode(copies))
    return salted.join(repeated, [on, SALT], how).drop(SALT)

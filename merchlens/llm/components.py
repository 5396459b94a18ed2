"""Connected components of a links table, by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.shared import Scratch


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


SMALL = 100_000  # links (1.6 MB) that are kept in one partition, where stars need no exchange


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` (least node of its component, itself included) of every node in ``links(a, b)`` (bigint).

    Each round writes the shrunken links to ``scratch``, from which the result reads, so lineage stays
    short; the rounds end when every node hangs on its root. Null ends are ignored.
    """
    links = scratch.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)

    def gathered(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if state[0] <= SMALL else df

    while state[0]:
        both = gathered(links.union(links.select("b", "a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a")
        links = scratch.written(gathered(step.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(step.select("a", F.col("m").alias("b")))).distinct(), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    return gathered(links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")))).distinct()

"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, subdivided where overfull.

Native: DataFrame functions only. The order of the rows is (key columns,
size); equal rows are counted together and told apart only by their number,
so a row that is repeated without end is still cut between shards.

1. Draw rows with a chance in proportion to their bytes (a hash of the key
   decides, so a rerun draws the same) and take weighted quantiles of the
   sample as boundaries of ``ranges`` key ranges.
2. Measure every range exactly; draw again inside those over twice the mean
   and subdivide them, until none is overfull or it is one row's copies.
3. The ranges' exact byte and row counts give each row its position in the
   whole order; a shard takes an equal stretch of bytes. Only ranges, never
   shards or tables, are sorted in one task.

Collected to the driver: the boundaries and one row of sums per range (at
most a few hundred). Null keys sort first, a null size counts as no bytes (such a
row stands where its key puts it). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.llm.shared import Scratch, written


def _range_of(key: Column, splitters: list[Column]) -> Column:
    """How many of the sorted ``splitters`` are at most ``key``: a binary search in steps of powers of two."""
    if not splitters:
        return F.lit(0)
    bounds, n = F.array(*splitters), len(splitters)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def _draw(rows: DataFrame, key: Column, weight: Column, seed: int, pieces: Column, rate: float, within: list[str]) -> list:
    """Boundaries that cut each group of ``within`` into ``pieces``, from a sample with about ``rate`` draws a byte."""
    chance = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    drawn = rows.where(chance < weight * rate).withColumn("_w", F.greatest(weight.cast("double"), F.lit(1.0 / rate))).withColumn("_k", key)
    group = Window.partitionBy(*within)
    so_far = F.sum("_w").over(group.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    cut = F.floor(F.coalesce(so_far, F.lit(0.0)) * pieces / F.sum("_w").over(group))
    return [r["k"] for r in drawn.withColumn("_cut", cut).where("_cut > 0").groupBy(*within, "_cut").agg(F.min("_k").alias("k")).collect()]


OUT = ("shard", "slot", "range")


def shard_rows(df: DataFrame, keys: list[str], size: str, shards: int = 8, ranges: int = 256, draws: int = 8192, rounds: int = 8, seed: int = 7) -> DataFrame:
    """Rows of ``df`` (key columns, size and any others) with ``shard``, ``slot`` (gapless in a shard) and ``range``, which replace columns of these names."""
    names = [c for c in df.columns if c not in OUT or c in (*keys, size)]
    # Inside, columns have names of their own, so that no column of the input can be taken for another.
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    by = [*(inner[c] for c in keys), *(inner[c] for c in names if c not in keys and c != size), inner[size]]
    plain = df.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names]).withColumn("bytes", F.coalesce(F.col(inner[size]), F.lit(0)).cast("bigint"))
    with Scratch(df.sparkSession, "sharding") as scratch:
        dealt = _dealt(plain, by, inner, size, shards, ranges, draws, rounds, seed, scratch)
    first = dealt.groupBy("_shard").agg(F.min("_i").alias("_first"))  # one row a shard
    return dealt.join(F.broadcast(first), "_shard").select(*[F.col(i).alias(c) for c, i in inner.items()], F.col("_shard").alias("shard"),
                                                          (F.col("_i") - F.col("_first")).alias("slot"), F.col("_range").alias("range"))


def _dealt(plain: DataFrame, by: list[str], inner: dict[str, str], size: str, shards: int, ranges: int, draws: int, rounds: int, seed: int, scratch: Scratch) -> DataFrame:
    """Rows with their range, their place in the whole order and their shard."""
    rows = scratch.written(plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("_n")), "rows")
    key = F.struct(*[F.col(c) for c in by])
    kinds = dict(rows.dtypes)
    weight = F.col("bytes") * F.col("_n")
    total = max(1, rows.agg(F.sum(weight)).first()[0] or 1)

    def literal(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in by])

    splitters = _draw(rows.withColumn("_all", F.lit(0)), key, weight, seed, F.lit(ranges), draws / total, ["_all"])
    for turn in range(rounds + 1):
        splitters = sorted(set(splitters), key=lambda r: tuple((r[c] is not None, r[c]) for c in by))
        placed = rows.withColumn("_r", _range_of(key, [literal(r) for r in splitters]))
        sums = placed.groupBy("_r").agg(F.sum(weight).alias("b"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).orderBy("_r").collect()
        over = [s for s in sums if s["b"] > 2 * total / ranges and s["k"] > 1]
        if not over or turn == rounds:
            break
        bytes_of = F.get(F.array(*[F.lit(s["b"]) for s in over]), F.array_position(F.array(*[F.lit(s["_r"]) for s in over]), F.col("_r")).cast("int") - 1)
        part = placed.where(F.col("_r").isin([s["_r"] for s in over])).withColumn("_b", bytes_of.cast("double"))
        more = _draw(part, key, weight, seed + turn + 1, F.ceil(F.col("_b") * ranges / total), 64.0 * ranges / total, ["_r"])
        if not set(more) - set(splitters):
            break
        splitters += more
    before, at = {}, (0, 0)
    for s in sums:
        before[s["_r"]] = at
        at = (at[0] + s["b"], at[1] + s["n"])
    width = len(splitters) + 1
    starts = [F.array(*[F.lit(before.get(r, (0, 0))[i]).cast("bigint") for r in range(width)]) for i in (0, 1)]
    earlier = Window.partitionBy("_r").orderBy(*[F.col(c).asc_nulls_first() for c in by]).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({
        "_b0": F.get(starts[0], F.col("_r")) + F.coalesce(F.sum(weight).over(earlier), F.lit(0)),
        "_n0": F.get(starts[1], F.col("_r")) + F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
    single = placed.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    middle = (F.col("_b0") + F.col("_c") * F.col("bytes")) * 2 + F.col("bytes")
    dealt = single.select(*inner.values(), F.col("_r").alias("_range"), (F.col("_n0") + F.col("_c")).alias("_i"),
                          F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)).cast("int")).alias("_shard"))
    return written(dealt, "shard-dealt")

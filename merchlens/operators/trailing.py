"""Trailing windows kept as daily partial sums.

A report that sums the days after a moving start reads its whole window every
day. Here each day's facts are reduced once to a row per key (partial sums and a row
count), stored by day, and the window's totals are carried on: the days that
came in are added, the days that fell out are taken away. Sums are exact
(integers and decimals), so a carried total equals the sum from scratch; a key
goes when its rows are used up, and a measure is null again when its values are. A day's step reads the totals, one day in and one
day out, whatever the window's length.

Every state is a table of its own, named by its window, and is written from the
state before it; a step that failed is run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import delete_folder, shared_folder, write_partitions

DAY, ROWS = "partial_day", "partial_rows"


def _held(measure: str) -> str:
    """Column that counts the values (not null) of a measure."""
    return f"{measure}__values"


class TrailingTotals:
    """Sums of ``measures`` (output -> input column) per key over the days after ``start``, up to ``until``."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], measures: Mapping[str, str], date_col: str = "date", folder: str | None = None):
        self.spark, self.keys, self.measures, self.date_col = spark, list(keys), dict(measures), date_col
        self.folder = (folder or shared_folder(spark, "trailing")).rstrip("/")
        self._sums = [*self.measures, *map(_held, self.measures), ROWS]
        self._schema: T.StructType | None = None

    # ------------------------------------------------------------------ daily partials
    def load(self, facts: DataFrame) -> "TrailingTotals":
        """Reduce facts to their days and store them; the days that occur are replaced, so a day is loaded whole, and again if it was corrected
        before it entered a state."""
        floats = [c for c in self.measures.values() if isinstance(facts.schema[c].dataType, (T.FloatType, T.DoubleType))]
        if floats:
            raise TypeError(f"sums of {floats} would depend on their order: cast them to decimals")
        days = (facts.groupBy(F.to_date(self.date_col).alias(DAY), *self.keys)
                .agg(*[F.sum(c).alias(name) for name, c in self.measures.items()],
                     *[F.count(c).alias(_held(name)) for name, c in self.measures.items()], F.count(F.lit(1)).alias(ROWS)))
        days = days.where(F.col(DAY).isNotNull())
        self._schema = days.schema
        write_partitions(days, f"{self.folder}/days", DAY, self.keys, mode="replace")
        return self

    def days(self, after: dt.date | None, until: dt.date | None) -> DataFrame:
        """Partials of the days in (after, until]."""
        df = self.spark.read.schema(self._schema).parquet(f"{self.folder}/days")
        if after is not None:
            df = df.filter(F.col(DAY) > F.lit(after))
        return df if until is None else df.filter(F.col(DAY) <= F.lit(until))

    # ------------------------------------------------------------------------- totals
    def _merged(self, parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
        """Sum of frames of partials, each taken times 1 or -1."""
        signed = [df.select(*self.keys, *[(F.col(m) if sign > 0 else -F.col(m)).alias(m) for m in self._sums]) for df, sign in parts]
        kind = {f.name: f.dataType for f in self._schema.fields}
        merged = reduce(DataFrame.unionByName, signed).groupBy(*self.keys).agg(*[F.sum(m).cast(kind[m]).alias(m) for m in self._sums])
        return merged.filter(F.col(ROWS) > 0)

    def _path(self, start: dt.date, until: dt.date) -> str:
        return f"{self.folder}/totals-{start.isoformat()}-{until.isoformat()}"

    def _state(self, start: dt.date, until: dt.date) -> DataFrame:
        kept = T.StructType([f for f in self._schema.fields if f.name != DAY])
        return self.spark.read.schema(kept).parquet(self._path(start, until))

    def build(self, start: dt.date, until: dt.date) -> None:
        """Totals of the days in (start, until], from all their partials."""
        self._merged([(self.days(start, until), 1)]).write.mode("overwrite").parquet(self._path(start, until))

    def advance(self, old: tuple[dt.date, dt.date], new: tuple[dt.date, dt.date]) -> None:
        """Totals of the window ``new`` (start, until) from those of ``old``, which lies before it and overlaps it."""
        if not old[0] <= new[0] <= old[1] <= new[1]:
            raise ValueError(f"the window {new} doesn't follow {old}")
        parts = [(self._state(*old), 1)]
        parts += [(self.days(old[1], new[1]), 1)] if new[1] > old[1] else []
        parts += [(self.days(old[0], new[0]), -1)] if new[0] > old[0] else []
        self._merged(parts).write.mode("overwrite").parquet(self._path(*new))

    def totals(self, start: dt.date, until: dt.date) -> DataFrame:
        state = self._state(start, until)
        return state.select(*self.keys, *[F.when(F.col(_held(m)) > 0, F.col(m)).alias(m) for m in self.measures])

    def forget(self, start: dt.date, until: dt.date) -> None:
        """Delete a state that no later one will be carried on from."""
        delete_folder(self.spark, self._path(start, until))

    def drop(self) -> None:
        delete_folder(self.spark, self.folder)

"""The funnel mart, stored by event day and refreshed day by day.

``load`` writes the mart once. When rows arrive late, ``refresh`` computes only
the days that they touch and overwrites those partitions (dynamic partition
overwrite): all other days keep their files. Every step can be repeated: the
days are recomputed from their inputs, staged, and swapped in, so a refresh
that failed half-way is mended by running it again. Period flags depend on the
reporting date and are added when the mart is read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.funnel import with_flags
from ..sources.stored import delete_folder, partition_values, shared_folder, write_partitions

DAY = "event_day"
SORT = ("country_code", "source")


def touched_days(*events: DataFrame) -> list[dt.date]:
    """Days of frames of one date or timestamp column each; a calendar's days at most come to the driver."""
    days = None
    for df in events:
        part = df.select(F.to_date(df.columns[0]).alias(DAY))
        days = part if days is None else days.unionByName(part)
    return sorted(r[0] for r in days.where(F.col(DAY).isNotNull()).distinct().collect())


class MartStore:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or shared_folder(spark, "mart")).rstrip("/")
        self._schema = None

    def _dated(self, mart: DataFrame) -> DataFrame:
        rows = mart.withColumn(DAY, F.to_date("event_date"))
        self._schema = rows.schema
        return rows

    def load(self, mart: DataFrame) -> "MartStore":
        """Write all of ``mart`` (rows of ``mart_rows``)."""
        write_partitions(self._dated(mart), self.folder, DAY, SORT)
        return self

    def refresh(self, mart: DataFrame, days: Iterable[dt.date]) -> list[dt.date]:
        """Replace ``days`` by their rows of ``mart``; a day that has none any more goes. Returns the days written."""
        days = sorted(set(days))
        if not days:
            return []
        staged = shared_folder(self.spark, "mart-days")
        try:
            write_partitions(self._dated(mart).filter(F.col(DAY).isin(days)), staged, DAY, SORT)
            held = {dt.date.fromisoformat(d) for d in partition_values(self.spark, staged, DAY)}
            if held:
                write_partitions(self.spark.read.schema(self._schema).parquet(staged), self.folder, DAY, SORT, mode="replace")
            for day in set(days) - held:
                delete_folder(self.spark, f"{self.folder}/{DAY}={day.isoformat()}")
        finally:
            delete_folder(self.spark, staged)
        return sorted(held)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.folder).drop(DAY)

    def read(self, as_of: str | dt.date | dt.datetime) -> DataFrame:
        """The mart at a reporting date, as ``kpi_mart`` returns it."""
        return with_flags(self.rows(), as_of)

    def drop(self) -> None:
        delete_folder(self.spark, self.folder)

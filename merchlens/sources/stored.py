"""Warehouse tables stored in layouts that a join or a filter can use.

``MonthlyFunnel`` stores the funnel's inputs by month, so that a report's date
bound prunes partitions, also those of a fact that has no date of its own: the attribution
facts are stored by the month in which their opportunity closed, and joined on
that month too, so a bound on opportunities prunes them as well.

``BucketedWarehouse`` stores tables bucketed on a join key: joins and
aggregations on that key need no exchange, as often as they are repeated.

All tables lie in one folder below ``spark.checkpoint.dir``, which the caller
drops (``drop()``) when nothing reads from it any more.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .warehouse import Warehouse

# Month (its first day) of an opportunity's closing, and of a rollup row.
CLOSED_MONTH, ROLLUP_MONTH = "closed_month", "rollup_month"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def partition_values(spark: SparkSession, folder: str, column: str) -> list[str]:
    """Values of a table's partition folders, in order; none if the table isn't there."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return sorted(n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}="))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what reads it several times computes it once."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_partitions(df: DataFrame, folder: str, column: str, sort: Sequence[str], *, mode: str = "errorifexists") -> None:
    """Write ``df`` partitioned by ``column``; the mode "replace" overwrites the partitions that occur in ``df`` and leaves the others.

    Rows are rebalanced by the partition column first: a task writes few partitions, and a large partition is written by several
    tasks. (Ranges would be drawn from a sample, for which all of ``df`` is computed once more.)
    """
    write = df.hint("rebalance", column).sortWithinPartitions(column, *sort).write.partitionBy(column)
    if mode == "replace":
        write = write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        write = write.mode(mode)
    write.parquet(folder)


def _month(c: str) -> Column:
    return F.trunc(c, "month")


class MonthlyFunnel(Warehouse):
    """The three inputs of the funnel mart, stored by month."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None):
        super().__init__(spark, sf_dir)
        self.folder = (folder or shared_folder(spark, "funnel")).rstrip("/")
        self._schemas: dict[str, object] = {}
        self._months: list[dt.date] | None = None

    def store(self, opps: DataFrame | None = None, attribution: DataFrame | None = None, rollup: DataFrame | None = None) -> "MonthlyFunnel":
        """Write the tables (by default all that the adapter has); what later arrives is added by ``append``."""
        source = Warehouse(self.spark, self.sf_dir)
        self.append(source.opportunity_dim() if opps is None else opps, source.attribution_facts() if attribution is None else attribution,
                    source.funnel_rollup_daily() if rollup is None else rollup)
        return self

    def append(self, opps: DataFrame, attribution: DataFrame, rollup: DataFrame) -> None:
        """Add rows to their months. An attribution row is filed under the month of its opportunity, which must
        be stored or come with it; without one it stays, in the partition of null."""
        self._write("opportunity_dim", opps.withColumn(CLOSED_MONTH, _month("opportunity_closed_date")), CLOSED_MONTH, "_plus_opportunity_key")
        closed = self._read("opportunity_dim").select("_plus_opportunity_key", CLOSED_MONTH)
        self._write("attribution_facts", attribution.join(closed, "_plus_opportunity_key", "left"), CLOSED_MONTH, "_plus_opportunity_key")
        self._write("funnel_rollup_daily", rollup.withColumn(ROLLUP_MONTH, _month("date")), ROLLUP_MONTH, "_source_key")

    def of_months(self, months: Sequence[dt.date]) -> "MonthlyFunnel":
        """The same tables, only the partitions of these months (first days)."""
        part = MonthlyFunnel(self.spark, self.sf_dir, self.folder)
        part._schemas, part._months = self._schemas, sorted(set(months))
        return part

    def _write(self, name: str, df: DataFrame, column: str, sort: str) -> None:
        self._schemas[name] = df.schema
        write_partitions(df, f"{self.folder}/{name}", column, [sort], mode="append")

    def _read(self, name: str) -> DataFrame:
        whole = self.spark.read.schema(self._schemas[name]).parquet(f"{self.folder}/{name}")
        if self._months is None:
            return whole
        return whole.filter(F.col(ROLLUP_MONTH if name == "funnel_rollup_daily" else CLOSED_MONTH).isin(self._months))

    @staticmethod
    def _since(df: DataFrame, column: str, since: dt.date | None) -> DataFrame:
        return df if since is None else df.filter(F.col(column) >= F.lit(since.replace(day=1)))

    def opportunity_dim(self, since: dt.date | None = None) -> DataFrame:
        return self._since(self._read("opportunity_dim"), CLOSED_MONTH, since)

    def attribution_facts(self) -> DataFrame:
        return self._read("attribution_facts")

    def funnel_rollup_daily(self, since: dt.date | None = None) -> DataFrame:
        return self._since(self._read("funnel_rollup_daily"), ROLLUP_MONTH, since)

    def drop(self) -> None:
        delete_folder(self.spark, self.folder)


class StoredTables(Warehouse):
    """Some of the adapter's tables, written as catalog tables into one folder. Their dated methods' bounds are dropped: the
    report's own date filters remain and reach the stored columns."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None):
        super().__init__(spark, sf_dir)
        self.folder = (folder or shared_folder(spark, "tables")).rstrip("/")
        self._names: dict[str, str] = {}

    def _save(self, table: str, write) -> str:
        """Save a table through the given writer and answer for the adapter's method of its name from now on."""
        name = self._names[table] = f"{table}_{uuid.uuid4().hex[:12]}"
        write.option("path", f"{self.folder}/{table}").format("parquet").saveAsTable(name)
        return name

    def _serve(self) -> None:
        for table in self._names:
            setattr(self, table, lambda *_, t=table, **__: self.spark.table(self._names[t]))

    def drop(self) -> None:
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folder(self.spark, self.folder)


class BucketedWarehouse(StoredTables):
    """Tables stored in ``buckets`` buckets of a join key each: ``keys`` maps a table (a method of the adapter) to its key.

    Choose buckets so that one fits a task: a hot key stays in one bucket, and
    adaptive execution can't split what isn't shuffled.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, keys: Mapping[str, str], buckets: int = 16, folder: str | None = None):
        super().__init__(spark, sf_dir, folder)
        self.keys, self.buckets = dict(keys), buckets

    def store(self) -> "BucketedWarehouse":
        for table, key in self.keys.items():
            df = getattr(Warehouse, table)(self)
            if key == "order_key":  # the order's number as the reports compare it
                df = df.withColumn(key, F.col("order_id").cast("string"))
            # The same hash that bucketing uses: a task writes one bucket, in one file.
            self._save(table, df.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key))
        self._serve()
        return self


class AnalyzedWarehouse(StoredTables):
    """Tables stored with row counts and column statistics, so that cost-based planning sees how small a filtered side is.

    Without them the size of a filtered table is taken to be that of the whole.
    ``store`` turns cost-based planning and join reordering on for the session; tables without statistics are planned as before.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Sequence[str], folder: str | None = None):
        super().__init__(spark, sf_dir, folder)
        self.tables = list(tables)

    def store(self) -> "AnalyzedWarehouse":
        for table in self.tables:
            df = getattr(Warehouse, table)(self)
            name = self._save(table, df.write)
            # Spark's estimates of filters fail on statistics of timestamps without a zone.
            known = ", ".join(f"`{c}`" for c, kind in df.dtypes if kind != "timestamp_ntz")
            self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {known}")
        for setting in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
            self.spark.conf.set(setting, "true")
        self._serve()
        return self

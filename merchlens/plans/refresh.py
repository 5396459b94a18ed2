"""Run several reports in one job, sharing the expensive adapter tables.

Every report derives its inputs from the source tables; several of those
derivations (the line x order join, the merchant groups, the opportunity
dimension, the funnel rollup input) feed many reports. ``refresh_reports``
writes each shared table once as parquet under the shared folder named by
``spark.checkpoint.dir`` and then runs the reports on those written tables.
That bounds every report's lineage at the written tables, so a lost executor
costs recomputation back to them only. It also stops the big joins from
being recomputed once per report. Results are written as parquet, one folder
per report.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.warehouse import Warehouse
from . import catalog

# Adapter tables worth writing once: each feeds several reports and is
# expensive to derive (joins or aggregations over the big tables).
SHARED_TABLES = ("order_lines", "merchants", "shops", "opportunity_dim", "funnel_rollup_daily")


class WrittenWarehouse(Warehouse):
    """A source adapter whose shared tables are read back from written parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, tables: Iterable[str] = SHARED_TABLES):
        super().__init__(spark, sf_dir)
        self.folder = folder.rstrip("/")
        self.tables = tuple(tables)
        self._written: set[str] = set()

    def _shared(self, name: str, build) -> DataFrame:
        path = f"{self.folder}/{name}"
        if name not in self._written:
            build().write.mode("overwrite").parquet(path)
            self._written.add(name)
        return self.spark.read.parquet(path)

    def order_lines(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        return self.bounded(self._shared("order_lines", super().order_lines), "l_shipdate", since, until)

    def merchants(self) -> DataFrame:
        return self._shared("merchants", super().merchants)

    def shops(self) -> DataFrame:
        return self._shared("shops", super().shops)

    def opportunity_dim(self, since: dt.date | None = None) -> DataFrame:
        written = self._shared("opportunity_dim", super().opportunity_dim)
        return written if since is None else written.filter(F.col("opportunity_closed_date") >= F.lit(dt.datetime.combine(since, dt.time())).cast("timestamp_ntz"))

    def funnel_rollup_daily(self, since: dt.date | None = None) -> DataFrame:
        written = self._shared("funnel_rollup_daily", super().funnel_rollup_daily)
        return written if since is None else written.filter(F.col("date") >= F.lit(since))


def refresh_reports(spark: SparkSession, sf_dir: str, out_dir: str | None = None,
                    names: Iterable[str] | None = None) -> dict[str, str]:
    """Write the selected registered queries (all by default) to ``out_dir``.

    Shared tables go to ``<spark.checkpoint.dir>/merchlens-<run id>/shared``
    and are deleted when the reports are written (or one fails); ``out_dir``
    defaults to ``.../reports`` next to them. Returns name -> path.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/merchlens-{uuid.uuid4().hex[:12]}"
    out_dir = (out_dir or f"{base}/reports").rstrip("/")
    wh = WrittenWarehouse(spark, sf_dir, f"{base}/shared")
    written = {}
    try:
        for name in names or catalog.BUILDERS:
            path = f"{out_dir}/{name}"
            catalog.BUILDERS[name](wh).write.mode("overwrite").parquet(path)
            written[name] = path
    finally:
        shared = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/shared")
        shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(shared, True)
    return written


def main(argv: list[str] | None = None) -> None:
    """``python -m merchlens.plans.refresh SF_DIR [--out DIR] [NAME ...]``"""
    import argparse
    import json

    from ..session import get_session

    parser = argparse.ArgumentParser(description="Write registered reports as parquet, sharing adapter tables.")
    parser.add_argument("sf_dir", help="folder holding the source parquet tables")
    parser.add_argument("names", nargs="*", help="registered query names (default: all)")
    parser.add_argument("--out", help="output folder (default: under spark.checkpoint.dir)")
    parser.add_argument("--master", help="Spark master, e.g. local[8] (default: from the environment)")
    args = parser.parse_args(argv)
    spark = get_session(args.master)
    print(json.dumps(refresh_reports(spark, args.sf_dir, args.out, args.names or None), indent=1))


if __name__ == "__main__":
    main()

"""Spark session settings the reports rely on.

Reports never build their own session; callers pass one in. ``get_session``
is a convenience for tests, the bench and the command line: it fixes the
session time zone to UTC (the warehouse's timestamps are UTC), keeps ANSI
mode on, and turns on adaptive execution so that shuffle partition counts,
broadcast conversion and skewed partitions are re-planned at run time from
real sizes instead of guesses.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every report assumes; applied on top of whatever the cluster sets.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that needs an extra shuffle:
    # a key holding a large share of the rows must not end up in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "merchlens") -> SparkSession:
    """Build or reuse a session with the settings above.

    ``shuffle_partitions`` is only an initial count; AQE coalesces small
    partitions after each shuffle, so on a cluster it should be sized for the
    largest stage (roughly shuffle bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def require_settings(spark: SparkSession) -> None:
    """Apply the settings results depend on to the caller's session; a setting that can't be applied is an error."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    alone; a machine-local folder is only chosen for local test sessions.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the server's setting applies
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="merchlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(current)
        spark.conf.set("spark.checkpoint.dir", current)
    return current

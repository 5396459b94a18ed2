"""The shared folder of a job: tables and files that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from merchlens.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` (not created yet)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the rows are computed once."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that a computation writes on its way: nothing that outlives it reads from them, so they are deleted with it."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.folder, self.paths = spark, new_folder(spark, purpose), {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``written`` into this scratch; an earlier table of the same name goes once the new one is there."""
        before, path = self.paths.get(name), f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[name] = path
        if before:
            delete_folder(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str) -> None:
        """Delete one table."""
        delete_folder(self.spark, self.paths.pop(name))

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self.spark, self.folder)


# Rows and bytes of an Arrow batch that a Python task gets: texts can be long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes to ``BATCH_ROWS`` and ``BATCH_BYTES`` if they are larger (or unlimited); operators on texts call this."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(name)).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def release_memory() -> None:
    """Give memory that this process has freed back to the system: workers live on from task to task, and keep what they once held."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

"""Shared plumbing of the training-data operators.

Everything here is about where intermediate tables live and how columns are named: the operators
themselves are in their own modules.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    A session without that setting gets a temporary folder only when driver and executors are one
    process (local mode); a cluster without it is an error, since a machine-local folder would lose
    tables with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="fathom-")
    return _LOCAL_FOLDERS[app]


#: Rows that go to Python at a time. Texts may be long, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 1000
#: Bytes of a batch, where one row does not hold more.
BATCH_BYTES = 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Bounds what Arrow batches of texts take, in the JVM and in Python, for the rest of the session."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


#: Shuffled bytes that a task takes, where the session says nothing else: rows grow when they are sorted, and again for Python.
TASK_BYTES = 1 << 24


def small_tasks(spark: SparkSession) -> None:
    """Keeps adaptive execution from merging shuffled partitions into tasks of Spark's default of 64 MB."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, str(TASK_BYTES))


def short_lived_shuffles(spark: SparkSession) -> None:
    """A query's shuffle files go when it ends, not when the driver's garbage is collected: what later queries need is written."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Tables written to the shared folder in order to cut lineage; dropped when no longer needed.

    keep() writes a DataFrame as Parquet and returns it as read back, so a lost executor costs a
    re-read and not the whole history of an iterative job. What a returned result still reads stays
    until the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/fathom/{label}-{uuid.uuid4().hex}"
        self.kept: list[str] = []
        small_batches(spark)
        small_tasks(spark)
        short_lived_shuffles(spark)
        atexit.register(self._end)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.kept):03d}-{name}"
        self.kept.append(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._fathom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_fathom_path", None)
        if path:
            self._delete(path)

    def only(self, df: DataFrame) -> DataFrame:
        """Drops every table but this one, which is all that a result still reads."""
        for path in self.kept:
            if path != df._fathom_path:
                self._delete(path)
        return df

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None and getattr(sc, "_gateway", None) is not None:
            try:
                self._delete(self.root)
            except Exception:  # the JVM may be gone already when the driver ends
                pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any of Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no input column has (input tables may carry clashing extra columns)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def bounded(batch, column: int, n_bytes: int = 1 << 24):
    """Slices of a batch of about that many bytes of a string column, one row at least."""
    texts = batch.column(column)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + n_bytes, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


#: Keys of two or three longs are broadcast up to this number (some 35 MB); more of them are shuffled.
BROADCAST_ROWS = 1 << 19


def joined_by_size(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The rows joined with a table of distinct keys, which is broadcast if it is small."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, how)

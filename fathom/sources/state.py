"""Persistent state as versioned Parquet snapshots, and tables written aside; both on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few file operations that state needs, by Hadoop's FileSystem: a folder is a path or a URI."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def read(self, path: str) -> str | None:
        """A small file's text; None if it isn't there."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside the file, then renames over it."""
        fs, at = self._at(path)
        _, new = self._at(f"{path}.new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(new, at):
            raise OSError(f"{path} could not be renamed into place")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def as_folder(folder: str | Path) -> str:
    """A URI as it is, a path made absolute."""
    text = str(folder)
    return text.rstrip("/") if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", text) else Path(text).resolve().as_uri()


class Snapshots:
    """A table with one writer. Readers see the version that the pointer names; a broken write leaves it alone.

    The pointer names the newest version that was written whole; should it be lost between the two steps of its renewal,
    the copy beside it, written first, names the same version.
    """

    def __init__(self, spark: SparkSession, folder: str | Path, name: str, schema: str, keep: int = 2):
        self.spark, self.schema, self.keep, self.files = spark, schema, keep, Files(spark)
        self.folder = f"{as_folder(folder)}/{name}"

    @property
    def version(self) -> int:
        pointer = self.files.read(f"{self.folder}/CURRENT") or self.files.read(f"{self.folder}/CURRENT.new")
        return int(pointer) if pointer else 0

    def read(self) -> DataFrame:
        """The current version, read with the full schema: columns that an older version lacks come back null."""
        if not (version := self.version):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version:08d}")

    def write(self, rows: DataFrame) -> int:
        new = self.version + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{new:08d}")
        self.files.write(f"{self.folder}/CURRENT", str(new))
        self._expire(new)
        return new

    def clear(self) -> None:
        for name in ("CURRENT", "CURRENT.new"):
            self.files.delete(f"{self.folder}/{name}")

    def _expire(self, current: int) -> None:
        for name in self.files.names(self.folder):
            if re.fullmatch(r"v\d{8}", name) and int(name[1:]) <= current - self.keep:
                self.files.delete(f"{self.folder}/{name}")


_LOCAL: dict[str, str] = {}


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder (spark.checkpoint.dir) and read back; they stay until the driver ends.

    Only a session in local mode without that setting gets a temporary folder.
    """
    spark = rows.sparkSession
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if (app := spark.sparkContext.applicationId) not in _LOCAL:
            _LOCAL[app] = Path(tempfile.mkdtemp(prefix="fathom-")).as_uri()
        folder = _LOCAL[app]
    path = f"{folder.rstrip('/')}/fathom/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and getattr(spark.sparkContext, "_gateway", None) is not None:
        try:
            Files(spark).delete(path)
        except Exception:  # the JVM may be gone already when the driver ends
            pass

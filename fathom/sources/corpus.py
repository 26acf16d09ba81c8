"""Corpora: a folder tree or any table, as (path, name, length, mtime, content, read_error).

Spark's binaryFile source leaves out empty files, dotfiles and names with a leading underscore, all of which a
scan must report, so folders have a source of their own. The driver lists, tasks read; partitions are packed
to about equal bytes, and a file that can't be read is a row with its error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, length bigint, mtime timestamp, content binary, read_error string"
PARTITION_BYTES = 64 << 20
PARTITION_FILES = 5000


class Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def checked_folder(folder: str | Path) -> Path:
    root = Path(folder)
    if not root.exists():
        raise FileNotFoundError(f"no such directory: {root}")
    if not root.is_dir():
        raise NotADirectoryError(f"not a directory: {root}")
    return root


def list_files(folder: str | Path, *, recursive: bool = True, include_hidden: bool = True, follow_symlinks: bool = False, exclude: tuple[str, ...] = ()) -> list[str]:
    """Regular files under a folder by name without case. Excluded paths, and files directly in them, are left out."""
    root = checked_folder(folder)
    hidden = lambda n: not include_hidden and n.startswith(".")
    barred = {str(Path(e).resolve()) for e in exclude}
    out = []
    for at, folders, names in os.walk(root, followlinks=follow_symlinks):
        folders[:] = [d for d in folders if not hidden(d) and str(Path(at, d).resolve()) not in barred] if recursive else []
        for n in names:
            p = Path(at, n)
            if hidden(n) or (p.is_symlink() and not follow_symlinks and not p.exists()) or not p.is_file():
                continue
            full = p.resolve()
            if str(full) not in barred and str(full.parent) not in barred:
                out.append(str(full))
    return sorted(set(out), key=lambda p: (p.casefold(), p))


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Batch]:
        flag = lambda k, d: self.options.get(k, d).lower() == "true"
        files = list_files(
            self.options["path"],
            recursive=flag("recursive", "true"),
            include_hidden=flag("includehidden", "true"),
            follow_symlinks=flag("followsymlinks", "false"),
            exclude=tuple(x for x in self.options.get("exclude", "").split("\n") if x),
        )
        out, now, size = [], [], 0
        for f in files:
            n = os.path.getsize(f) if os.path.exists(f) else 0
            if now and (size + n > PARTITION_BYTES or len(now) >= PARTITION_FILES):
                out.append(Batch(now))
                now, size = [], 0
            now.append(f)
            size += n
        return [*out, Batch(now)] if now else out or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for p in partition.paths:
            name = os.path.basename(p)
            try:
                stat = os.stat(p)
                data = Path(p).read_bytes()
                yield p, name, len(data), datetime.fromtimestamp(stat.st_mtime, UTC), data, None
            except OSError as e:
                yield p, name, None, None, None, f"read failed: {e}"


class CorpusSource(DataSource):
    """``spark.read.format("corpus").option("path", ...)``: recursive, includeHidden, followSymlinks, exclude (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader({k.lower(): v for k, v in self.options.items()})


def read_corpus(spark: SparkSession, folder: str | Path, *, recursive: bool = True, include_hidden: bool = True, follow_symlinks: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    checked_folder(folder)
    spark.dataSource.register(CorpusSource)
    options = {"path": str(folder), "recursive": str(recursive), "includeHidden": str(include_hidden), "followSymlinks": str(follow_symlinks), "exclude": "\n".join(exclude)}
    return spark.read.format("corpus").options(**options).load()


def from_table(rows: DataFrame, path, content, mtime=None) -> DataFrame:
    """Any table as a corpus: columns for the path and the bytes (text is taken as UTF-8)."""
    name = F.element_at(F.split(path, "/"), -1)
    data = F.encode(content, "UTF-8") if dict(rows.select(content.alias("c")).dtypes)["c"] == "string" else content
    return rows.select(
        path.alias("path"),
        name.alias("name"),
        F.octet_length(data).cast("long").alias("length"),
        (F.lit(None).cast("timestamp") if mtime is None else mtime).alias("mtime"),
        data.alias("content"),
        F.when(data.isNull(), F.lit("read failed: no content")).alias("read_error"),
    )

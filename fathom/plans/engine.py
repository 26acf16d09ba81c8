"""The scan engine: source, measurement, join with the baseline, verdict, new baseline; and the operations on state."""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import core, quarantine
from ..sources.corpus import SCHEMA, read_corpus
from ..sources.state import Snapshots, written


class Engine:
    def __init__(self, spark: SparkSession, config: Config = Config()):
        self.spark, self.config = spark, config
        self.baseline = Snapshots(spark, config.state_dir, "file_metadata", core.BASELINE)
        self.log = Snapshots(spark, config.state_dir, "quarantine_log", quarantine.LOG)

    @property
    def internal(self) -> tuple[str, ...]:
        return (self.config.state_dir, *((self.config.quarantine_dir,) if self.config.exclude_quarantine else ()))

    def files(self, folder: str | Path, recursive: bool = True) -> DataFrame:
        c = self.config
        return read_corpus(self.spark, folder, recursive=recursive, include_hidden=c.include_hidden, follow_symlinks=c.follow_symlinks, exclude=self.internal)

    def scan(self, folder: str | Path, recursive: bool = True, now: float | None = None) -> DataFrame:
        """Results of a folder, in order of path. The baseline moves on with them."""
        return self.judge(self.files(folder, recursive), now)

    def judge(self, files: DataFrame, now: float | None = None) -> DataFrame:
        now = time.time() if now is None else now
        # written, not cached: a lost block would be made again from files that may have moved meanwhile
        results = written(core.analyze(files, self.baseline.read(), now, self.config), "results")
        self.baseline.write(core.next_baseline(self.baseline.read(), results, now))
        return results.orderBy(F.lower("path"), "path")

    def analyze_paths(self, paths: Iterable[str | Path], now: float | None = None) -> DataFrame:
        """Results of files named one by one; MISSING for those that aren't there."""
        asked = [(str(Path(p).resolve()),) for p in dict.fromkeys(map(str, paths))]
        return self.judge(core.requested(self.spark.createDataFrame(asked, "path string"), self._rows(p for (p,) in asked)), now)

    def _rows(self, paths: Iterable[str]) -> DataFrame:
        rows = []
        for p in map(Path, paths):
            try:
                if p.exists():
                    data = p.read_bytes() if p.is_file() else None
                    rows.append((str(p), p.name, len(data or b""), datetime.fromtimestamp(p.stat().st_mtime, UTC), data, None if p.is_file() else "not a regular file"))
            except OSError as e:
                rows.append((str(p), p.name, None, None, None, f"read failed: {e}"))
        return self.spark.createDataFrame(rows, SCHEMA)

    def rebaseline(self, targets: Iterable[str | Path], *, recursive: bool = True, force: bool = False, dry_run: bool = False, now: float | None = None) -> DataFrame:
        """What became of each target; accepted ones are the new baseline unless it is a dry run."""
        now = time.time() if now is None else now
        named, files = [], None
        for t in dict.fromkeys(str(Path(x).resolve()) for x in targets):
            if Path(t).is_dir():
                found = self.files(t, recursive).withColumn("missing", F.lit(False))
                files = found if files is None else files.unionByName(found)
            else:
                named.append((t,))
        if named or files is None:
            single = core.requested(self.spark.createDataFrame(named, "path string"), self._rows(p for (p,) in named)).withColumn("length", F.length("content").cast("long"))
            files = single if files is None else files.unionByName(single)
        barred = [str(Path(p).resolve()) for p in self.internal]
        internal = F.lit(False)
        for b in barred:
            internal = internal | (F.col("path") == b) | F.startswith("path", F.lit(b + "/"))
        measured = core.measure(files, self.config).withColumn("internal", internal)
        before = self.baseline.read().select(F.col("file_path").alias("path"), F.col("last_status").alias("previous_status"))
        outcomes = written(core.rebaseline_outcomes(measured.join(before, "path", "left"), force=force), "outcomes")
        if not dry_run:
            self.baseline.write(core.rebaselined(self.baseline.read(), outcomes, now))
        return outcomes.select("path", "action", "previous_status", "reason")

    def quarantine(self, paths: Iterable[str], reason: str = quarantine.REASON) -> DataFrame:
        """Moves files and logs them; (path, ok) of each."""
        moved, done = [], []
        at = datetime.now(UTC)
        barred = frozenset(Path(p).resolve() for p in self.internal)
        for p in paths:
            to = quarantine.move_in(p, self.config.quarantine_dir, barred, at)
            done.append((str(p), to is not None))
            if to is not None:
                moved.append((str(Path(p).resolve()), str(to), reason, at.isoformat()))
        if moved:
            rows = self.spark.createDataFrame(moved, "original_path string, quarantine_path string, reason string, action_date string")
            self.log.write(quarantine.appended(self.log.read(), rows))
        return self.spark.createDataFrame(done, "path string, ok boolean")

    def list_quarantine(self, *, include_restored: bool = False) -> DataFrame:
        return quarantine.listing(self.log.read(), include_restored=include_restored)

    def restore(self, quarantine_path: str | Path, destination: str | Path | None = None) -> Path:
        row = quarantine.find(self.log.read(), str(Path(quarantine_path).resolve())).first()
        if row is None:
            raise FileNotFoundError(f"no unrestored quarantine entry for {quarantine_path}")
        to = quarantine.move_back(row["quarantine_path"], destination or row["original_path"])
        done = self.spark.createDataFrame([(row["id"], datetime.now(UTC).isoformat())], "id bigint, restored_at string")
        self.log.write(quarantine.restored(self.log.read(), done))
        return to

    def clear_baseline(self) -> None:
        self.baseline.clear()

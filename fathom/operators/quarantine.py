"""The quarantine log as a table, and the moves that go with it.

Queries on the log are plans. Moving files is a side effect: it happens once, on the driver, for a list that
a plan has already settled, and never inside a task, where a retry would repeat it.
"""

from __future__ import annotations

import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "id bigint, original_path string, quarantine_path string, reason string, action_date string, restored_at string"
REASON = "Automated Quarantine"


def listing(log: DataFrame, *, include_restored: bool = False) -> DataFrame:
    """Newest first."""
    rows = log if include_restored else log.where("restored_at IS NULL")
    return rows.orderBy(F.desc("action_date"), F.desc("id"))


def find(log: DataFrame, quarantine_path: str) -> DataFrame:
    return listing(log).where(F.col("quarantine_path") == quarantine_path).limit(1)


def appended(log: DataFrame, moved: DataFrame) -> DataFrame:
    """The log with new rows (original_path, quarantine_path, reason, action_date), numbered on from its last id."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = moved.withColumn("id", F.row_number().over(_by_time()))  # as many rows as the driver has moved files
    new = numbered.crossJoin(F.broadcast(last)).select((F.col("id") + F.col("last")).cast("long").alias("id"), "original_path", "quarantine_path", "reason", "action_date", F.lit(None).cast("string").alias("restored_at"))
    return log.unionByName(new)


def _by_time():
    from pyspark.sql import Window

    return Window.orderBy("action_date", "original_path")


def restored(log: DataFrame, done: DataFrame) -> DataFrame:
    """The log with restored_at set for the ids in done (id, restored_at)."""
    return log.alias("l").join(done.select("id", F.col("restored_at").alias("at")), "id", "left").select("id", "original_path", "quarantine_path", "reason", "action_date", F.coalesce("at", "restored_at").alias("restored_at"))


def strays(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files in the quarantine folder that no unrestored row of the log knows."""
    known = log.where("restored_at IS NULL").select(F.element_at(F.split("quarantine_path", "/"), -1).alias("name"))
    return files.join(known, "name", "left_anti")


def _stamp(at: datetime) -> str:
    return at.strftime("%Y%m%d_%H%M%S_%f")


def move_in(path: str | Path, folder: str | Path, internal: frozenset[Path] = frozenset(), at: datetime | None = None) -> Path | None:
    """Moves a file into quarantine; None for an internal, quarantined or absent one."""
    source, folder, at = Path(path).resolve(), Path(folder).resolve(), at or datetime.now(UTC)
    if not source.is_file() or source in internal or source.parent in internal or folder in source.parents:
        return None
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{source.stem}_{_stamp(at)}{source.suffix}.quarantine"
    shutil.move(source, target)
    return target


def move_back(quarantined: str | Path, original: str | Path, at: datetime | None = None) -> Path:
    """Moves a file back, beside whatever has taken its place meanwhile."""
    target = Path(original)
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists():
        target = target.with_name(f"{target.stem}_restored_{_stamp(at or datetime.now(UTC))}{target.suffix}")
    shutil.move(Path(quarantined), target)
    return target

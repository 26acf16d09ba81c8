"""Searching, sorting and merging result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCHED = ("path", "status", "file_type", "message", "checksum", "size_bytes")


def search(results: DataFrame, text: str = "", *, corrupted_only: bool = False) -> DataFrame:
    """Rows that have the text in any of their fields, whatever its case."""
    rows = results.where("is_corrupted") if corrupted_only else results
    if not (text := text.strip().lower()):
        return rows
    fields = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in SEARCHED)))
    return rows.where(F.contains(fields, F.lit(text)))


def sorted_by(results: DataFrame, column: str = "path", *, descending: bool = False) -> DataFrame:
    """By size as a number, by other columns without case; ties by path."""
    key = F.col(column) if column == "size_bytes" else F.lower(F.col(column).cast("string"))
    return results.orderBy(key.desc() if descending else key.asc(), F.lower("path"), "path")


def shown(results: DataFrame, verbose: bool) -> DataFrame:
    return results if verbose else results.where("is_corrupted")


def without(results: DataFrame, handled: DataFrame) -> DataFrame:
    """The rows whose path was not handled."""
    return results.join(handled.select("path"), "path", "left_anti")


def merge_refreshed(results: DataFrame, refreshed: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed paths go; the others have their refreshed row where there is one."""
    left = without(results, removed)
    names = results.columns
    joined = left.alias("o").join(refreshed.dropDuplicates(["path"]).alias("n"), "path", "left")
    fresh = F.col("n.status").isNotNull()
    return joined.select(*(F.col("path") if c == "path" else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names))


def overlay(outcomes: DataFrame, forced: DataFrame) -> DataFrame:
    """Outcomes with those of one path replaced by the forced ones."""
    return outcomes.join(forced.select("path"), "path", "left_anti").unionByName(forced)

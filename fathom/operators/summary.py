"""Summaries of result tables, each a single aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def scan_summary(results: DataFrame) -> DataFrame:
    """One row over results with status, is_corrupted, has_fault, is_warning, size_bytes.

    Whatever is not corrupt counts as healthy, faults and warnings included.
    """
    corrupted = F.count_if("is_corrupted")
    return results.agg(
        F.count(F.lit(1)).alias("total_files"),
        corrupted.alias("corrupted_files"),
        (F.count(F.lit(1)) - corrupted).alias("healthy_files"),
        F.count_if(F.col("status") == "SUSPECTED_RANSOMWARE").alias("suspected_ransomware_files"),
        F.count_if("has_fault").alias("unreadable_files"),
        F.count_if(F.col("is_warning") & ~F.col("is_corrupted")).alias("warning_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max("size_bytes"), F.lit(0)).alias("largest_file_bytes"),
        F.coalesce(F.try_divide(corrupted * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("corruption_rate_percent"),
    )


def type_histogram(results: DataFrame, *, corrupted_only: bool = False, column: str = "file_type") -> DataFrame:
    """file_type and its count, most frequent first, then by name."""
    rows = results.where("is_corrupted") if corrupted_only else results
    return rows.groupBy(F.col(column).alias("file_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_type")


def top_extensions(files: DataFrame, limit: int = 5) -> DataFrame:
    ext = F.when(F.col("ext") == "", F.lit("<none>")).otherwise(F.col("ext"))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(limit)


def top_errors(results: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent error messages of corrupted rows; ties by message."""
    rows = results.where(F.col("is_corrupted") & F.col("error").isNotNull())
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(limit)


def performance(results: DataFrame, seconds: float, processors: int, given: Mapping[str, float] | None = None) -> DataFrame:
    """One row of counts and rates; values given from outside hold where they are above zero."""
    given = given or {}
    keep = lambda name, value: F.coalesce(F.nullif(F.greatest(F.lit(float(given.get(name, 0))), F.lit(0.0)), F.lit(0.0)), value.cast("double")).alias(name)
    files, size, bad = F.count(F.lit(1)), F.coalesce(F.sum("file_size"), F.lit(0)), F.count_if("is_corrupted")
    rate = lambda x: F.lit(0.0) if seconds <= 0 else x / F.lit(seconds)
    return results.agg(
        keep("total_files", files),
        keep("corrupted_files", bad),
        keep("total_size_bytes", size),
        F.lit(seconds).alias("seconds"),
        keep("files_per_second", rate(files)),
        keep("mb_per_second", rate(size / (1024 * 1024))),
        keep("corruption_rate_percent", F.coalesce(F.try_divide(bad * 100.0, files), F.lit(0.0))),
        F.lit(processors).alias("processors_used"),
    )


def verdict_of_rate(files_per_second) -> F.Column:
    return F.when(files_per_second >= 1000, "EXCELLENT").when(files_per_second >= 500, "GOOD").when(files_per_second >= 100, "MODERATE").otherwise("SLOW")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Per strategy over runs (strategy, seconds, files_per_second, mb_per_second): averages and the best time."""
    return runs.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.avg("seconds").alias("average_seconds"),
        F.min("seconds").alias("best_seconds"),
        F.avg("files_per_second").alias("average_files_per_second"),
        F.avg("mb_per_second").alias("average_mb_per_second"),
    )


def action_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def quarantine_counts(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def humanised_bytes(size) -> F.Column:
    """``512 B``, ``1.50 KB`` and so on to PB, by 1024."""
    x = F.greatest(size.cast("double"), F.lit(0.0))
    out = F.format_string(f"%.2f {_UNITS[-1]}", x / 1024.0 ** (len(_UNITS) - 1))
    for i in reversed(range(1, len(_UNITS) - 1)):
        out = F.when(x < 1024.0 ** (i + 1), F.format_string(f"%.2f {_UNITS[i]}", x / 1024.0**i)).otherwise(out)
    return F.when(x < 1024.0, F.format_string("%d B", F.floor(x))).otherwise(out)

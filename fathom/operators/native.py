"""The stateless verdict of the native analyzer: status, content kind, findings, duplicate groups, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytestats, dimensions, formats
from ..sources.state import written

STATUSES = ("OK", "EMPTY", "HIGH_NULL_BYTES", "REPEATING_PATTERN", "MAGIC_MISMATCH", "SUSPICIOUS_LOW_ENTROPY", "SUSPICIOUS_HIGH_ENTROPY_TEXT", "IO_ERROR")
NULL_SHARE, LOW_ENTROPY, HIGH_ENTROPY, BLOCK = 0.50, 0.02, 7.80, 16


def analyze(files: DataFrame) -> DataFrame:
    """path, ext, status, kind, findings, sha256 and statistics of each file; a row of its own for read errors."""
    ext, content, s = F.col("ext"), F.col("content"), F.col("_s")
    staged = files.withColumn("ext", formats.native_extension(F.col("name"))).withColumn("_s", bytestats.byte_statistics(content))
    staged = staged.withColumn("_repeats", bytestats.repeating_blocks(content, BLOCK)).withColumn("_magic", F.coalesce(formats.has_signature(dimensions.NATIVE_SIGNATURES), F.lit(True)))
    text = ext.isin(dimensions.NATIVE_TEXT)
    # not from the statistics, so that grouping by digest and size needs none of them
    size = F.length(content).cast("long")
    entropy, nulls, printable = s["entropy"], s["null_ratio"], s["printable_ratio"]
    tests = [
        (nulls > NULL_SHARE, "HIGH_NULL_BYTES", "null byte ratio exceeds configured threshold"),
        (F.col("_repeats"), "REPEATING_PATTERN", "repeating block pattern detected in header sample"),
        (~F.col("_magic"), "MAGIC_MISMATCH", "magic number does not match file extension"),
        ((entropy <= LOW_ENTROPY) & (size > 4), "SUSPICIOUS_LOW_ENTROPY", "entropy is extremely low for a non-trivial file"),
        (text & (entropy >= HIGH_ENTROPY) & (printable < 0.60), "SUSPICIOUS_HIGH_ENTROPY_TEXT", "text-like extension contains high-entropy non-printable data"),
    ]
    status = F.when(F.col("read_error").isNotNull(), F.lit("IO_ERROR")).when(size == 0, F.lit("EMPTY"))
    for holds, name, _ in tests:
        status = status.when(holds, F.lit(name))
    tail = (s["tail_zero_ratio"] > 0.95) & (size > bytestats.TAIL)
    found = F.array_compact(F.array(*(F.when(holds, F.lit(say)) for holds, _, say in tests), F.when(tail, F.lit("tail region is mostly zero-filled"))))
    findings = F.when(F.col("read_error").isNotNull(), F.array("read_error")).when(size == 0, F.array(F.lit("file is empty"))).otherwise(found)
    kind = (
        F.when(F.col("read_error").isNotNull() | (size == 0), F.lit("UNKNOWN"))
        .when(nulls >= 0.80, F.lit("MOSTLY_ZERO"))
        .when(F.col("_repeats"), F.lit("REPEATED_PATTERN"))
        .when(text | ((printable >= 0.85) & (nulls < 0.05) & (entropy <= 7.20)), F.lit("TEXT_LIKE"))
        .when((entropy >= 7.50) & (printable < 0.30), F.lit("COMPRESSED_OR_ENCRYPTED"))
        .otherwise(F.lit("STRUCTURED_BINARY"))
    )
    return staged.select(
        "path",
        "ext",
        status.otherwise(F.lit("OK")).alias("status"),
        kind.alias("kind"),
        findings.alias("findings"),
        F.when(size.isNotNull(), F.sha2(content, 256)).alias("sha256"),
        F.coalesce(size, F.lit(0)).alias("size_bytes"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.coalesce(nulls, F.lit(0.0)).alias("null_ratio"),
        F.coalesce(printable, F.lit(0.0)).alias("printable_ratio"),
        F.coalesce(s["unique_bytes"], F.lit(0)).alias("unique_bytes"),
        F.coalesce(s["max_run"], F.lit(0)).alias("max_run"),
        F.coalesce(s["tail_zero_ratio"], F.lit(0.0)).alias("tail_zero_ratio"),
    )


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """The rows with duplicate_group_id (1.. in order of first path, 0 for none) and duplicate_group_size.

    Contents are grouped by digest and size with partial aggregation; only groups of two and more are numbered
    and joined back, so a content that a third of all files share is no single task's work.
    """
    groups = rows.where("size_bytes > 0 AND sha256 IS NOT NULL").groupBy("sha256", "size_bytes").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_first")).where("_n > 1")
    # the established order is global: one number per group, by first path. Ranges are numbered apart, then offset; the
    # ranges are written, since two evaluations need not cut them alike
    ranged = groups.repartitionByRange(F.col("_first")).sortWithinPartitions("_first").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = written(ranged, "groups")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"), F.min("_row").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))  # one row per partition
    numbered = ranged.join(F.broadcast(offsets), "_part").select("sha256", "size_bytes", (F.col("_row") - F.col("_from") + F.col("_before") + 1).alias("duplicate_group_id"), F.col("_n").alias("duplicate_group_size"))
    joined = rows.join(numbered, ["sha256", "size_bytes"], "left").withColumn("duplicate_group_id", F.coalesce("duplicate_group_id", F.lit(0))).withColumn("duplicate_group_size", F.coalesce("duplicate_group_size", F.lit(1)))
    if "findings" not in rows.columns:
        return joined
    say = F.format_string("duplicate content group #%d (%d files)", F.col("duplicate_group_id"), F.col("duplicate_group_size"))
    return joined.withColumn("findings", F.when(F.col("duplicate_group_id") > 0, F.array_append("findings", say)).otherwise(F.col("findings")))


def summary(rows: DataFrame) -> DataFrame:
    """One row: files, healthy, io_errors, flagged, bytes, and duplicate groups, files and bytes."""
    dup = F.col("duplicate_group_id") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "OK").alias("healthy_files"),
        F.count_if(F.col("status") == "IO_ERROR").alias("io_errors"),
        F.count_if(~F.col("status").isin("OK", "IO_ERROR")).alias("flagged_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max("duplicate_group_id"), F.lit(0)).alias("duplicate_groups"),
        F.count_if(dup).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(dup, F.col("size_bytes"))), F.lit(0)).alias("duplicate_bytes"),
    )


def extension_ranking(rows: DataFrame) -> DataFrame:
    """Every extension by count, then name; ``<none>`` for files without one."""
    return rows.groupBy(F.when(F.col("ext") == "", F.lit("<none>")).otherwise(F.col("ext")).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext")


def has_findings(rows: DataFrame) -> bool:
    """Whether any file's status is other than OK (what --fail-on-findings asks)."""
    return not rows.where("status <> 'OK'").isEmpty()

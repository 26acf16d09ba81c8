"""The baseline-aware verdict: one status per file, and the state that the next scan compares with.

A scan is one plan: files, their metrics and validation, left-joined with the baseline on path. Nothing is
looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import bytestats, dimensions, formats
from .validation import validate

BASELINE = (
    "file_path string, size_bytes bigint, checksum string, last_modified double, is_corrupted int, shannon_entropy double, file_type string, analysis_date string, "
    "first_seen double, first_corrupt double, last_status string, last_seen double"
)

CORRUPT = ("CORRUPTED_SIZE", "CORRUPTED_CHECKSUM", "CORRUPTED_FORMAT", "SUSPECTED_RANSOMWARE")
FAULT = ("UNREADABLE", "ERROR")
WARNING = ("SUSPICIOUS_EMPTY", "SUSPICIOUS_HIGH_ENTROPY")
STATUSES = ("VALID", "NEW_FILE", *CORRUPT, *WARNING, "MISSING", *FAULT)


def measure(files: DataFrame, config: Config = Config()) -> DataFrame:
    """The files with ext, size_bytes, checksum, shannon_entropy and validation; content goes."""
    named = files.withColumn("ext", formats.extension(F.col("name")))
    checked = validate(named, deep=config.deep_validators)
    stats = bytestats.byte_statistics(F.col("content"))
    return (
        checked.withColumn("_s", stats)
        .withColumn("checksum", bytestats.checksum(F.col("content"), config.checksum))
        .withColumn("size_bytes", F.col("_s.size_bytes"))
        .withColumn("shannon_entropy", F.col("_s.entropy"))
        .drop("_s", "content")
    )


def _in(names: tuple[str, ...]) -> Column:
    return F.col("status").isin(list(names))


def status_column(config: Config = Config()) -> tuple[Column, Column]:
    """(status, reason) over measured columns and baseline columns b.*; the first rule that holds decides."""
    size, entropy, ext = F.col("size_bytes"), F.col("shannon_entropy"), F.col("ext")
    known = F.col("b.file_path").isNotNull()
    watched = F.lit(config.detect_ransomware) & (size > 0)
    high = watched & (entropy >= config.entropy_threshold)
    delta, ratio = entropy - F.col("b.shannon_entropy"), F.try_divide(size, F.col("b.size_bytes"))
    jumped = F.coalesce(high & (F.col("b.size_bytes") > 0) & (delta >= config.entropy_jump_threshold) & (ratio >= 0.5) & (ratio <= 2.0), F.lit(False))
    marked = watched & formats.is_one_of(dimensions.RANSOMWARE)
    vague = high & ~formats.is_one_of(dimensions.HIGH_ENTROPY_SAFE) & ~(F.col("validation.checked") & F.col("validation.is_valid"))
    status = (
        F.when(F.col("missing"), F.lit("MISSING"))
        .when(F.col("read_error").isNotNull() | F.col("validation").isNull(), F.lit("UNREADABLE"))
        .when(~F.col("validation.is_valid"), F.lit("CORRUPTED_FORMAT"))
        .when(marked | jumped, F.lit("SUSPECTED_RANSOMWARE"))
        .when(known & (F.col("b.size_bytes") != size), F.lit("CORRUPTED_SIZE"))
        .when(size == 0, F.lit("SUSPICIOUS_EMPTY"))
        .when(~known, F.lit("NEW_FILE"))
        .when(F.col("b.checksum") != F.col("checksum"), F.lit("CORRUPTED_CHECKSUM"))
        .otherwise(F.lit("VALID"))
    )
    reason = (
        F.when(marked, F.concat(F.lit("extension "), ext, F.lit(" is used by ransomware families")))
        .when(jumped, F.format_string("entropy jumped by %.2f bits/byte versus baseline (%.2f -> %.2f)", delta, F.col("b.shannon_entropy"), entropy))
        .when(size == 0, F.lit("empty file"))
        .when(vague, F.format_string("entropy %.2f bits/byte with no format validator", entropy))
    )
    return status, reason


def message_column() -> Column:
    """What a status means to a reader, with the first reason where there is one."""
    s = F.col("status")
    texts = {
        "CORRUPTED_SIZE": "file size differs from the recorded baseline",
        "CORRUPTED_CHECKSUM": "file checksum differs from the recorded baseline",
        "SUSPICIOUS_EMPTY": "file is empty",
        "MISSING": "file not found",
        "ERROR": "analysis could not be completed",
    }
    out = F.when(s == "CORRUPTED_FORMAT", F.coalesce("validation.error_message", F.lit("format validation failed")))
    out = out.when(s == "SUSPECTED_RANSOMWARE", F.concat(F.lit("file looks encrypted: "), F.coalesce("reason", F.lit("ransomware indicators matched"))))
    out = out.when(s == "UNREADABLE", F.coalesce("read_error", F.lit("file is unreadable")))
    for k, v in texts.items():
        out = out.when(s == k, F.lit(v))
    return out


def analyze(files: DataFrame, baseline: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    """One result row per file: status, message, flags, warnings, metrics and what the baseline had.

    ``files`` has path, name, mtime, content, read_error and may have ``missing`` (for paths asked for by name).
    """
    if "missing" not in files.columns:
        files = files.withColumn("missing", F.lit(False))
    status, reason = status_column(config)
    joined = measure(files, config).alias("f").join(baseline.alias("b"), F.col("f.path") == F.col("b.file_path"), "left")
    # metrics sit under plain names; the baseline's are reached through its alias
    own = [c for c in ("path", "name", "ext", "mtime", "read_error", "missing", "size_bytes", "checksum", "shannon_entropy", "validation")]
    wide = joined.select(*(F.col(f"f.{c}").alias(c) for c in own), F.struct("b.*").alias("b"))
    judged = wide.withColumn("status", status).withColumn("reason", F.when(F.col("missing") | F.col("read_error").isNotNull(), None).otherwise(reason))
    corrupt = _in(CORRUPT)
    kept = F.col("status").isin("SUSPICIOUS_EMPTY", "VALID") & F.col("reason").isNotNull()
    return judged.select(
        "path",
        "name",
        "ext",
        "status",
        message_column().alias("message"),
        corrupt.alias("is_corrupted"),
        _in(FAULT).alias("has_fault"),
        (_in(WARNING) | kept).alias("is_warning"),
        F.when(kept, F.array("reason")).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce("checksum", F.lit("")).alias("checksum"),
        F.coalesce("shannon_entropy", F.lit(0.0)).alias("shannon_entropy"),
        F.coalesce("validation.format_name", formats.format_name()).alias("file_type"),
        "validation",
        "mtime",
        F.col("b.size_bytes").alias("baseline_size_bytes"),
        F.when(corrupt, F.coalesce(F.col("b.first_corrupt"), F.lit(now))).otherwise(F.col("b.first_corrupt")).alias("first_corrupt"),
    )


def next_baseline(baseline: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """The baseline after a scan. A corrupt file keeps its old measurements, but a new one is put in as it is."""
    # only what was analysed is recorded
    new = results.where(~F.col("status").isin("MISSING", *FAULT)).alias("n")
    old = baseline.alias("o")
    both = old.join(new, F.col("o.file_path") == F.col("n.path"), "full_outer")
    seen, known = F.col("n.path").isNotNull(), F.col("o.file_path").isNotNull()
    take = seen & (~known | ~F.col("n.is_corrupted"))
    pick = lambda cond, n, o: F.when(cond, F.col(f"n.{n}")).otherwise(F.col(f"o.{o}")).alias(o)
    stamp = F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return both.select(
        F.coalesce("o.file_path", "n.path").alias("file_path"),
        pick(take, "size_bytes", "size_bytes"),
        pick(take, "checksum", "checksum"),
        F.when(seen, F.unix_micros(F.col("n.mtime")) / 1e6).otherwise(F.col("o.last_modified")).alias("last_modified"),
        F.when(seen, F.col("n.is_corrupted").cast("int")).otherwise(F.col("o.is_corrupted")).alias("is_corrupted"),
        pick(take, "shannon_entropy", "shannon_entropy"),
        pick(seen, "file_type", "file_type"),
        F.when(seen, stamp).otherwise(F.col("o.analysis_date")).alias("analysis_date"),
        F.coalesce(F.col("o.first_seen"), F.when(seen, F.lit(now))).alias("first_seen"),
        F.coalesce(F.when(seen, F.col("n.first_corrupt")), F.col("o.first_corrupt")).alias("first_corrupt"),
        pick(seen, "status", "last_status"),
        F.when(seen, F.lit(now)).otherwise(F.col("o.last_seen")).alias("last_seen"),
    )


def rebaseline_outcomes(targets: DataFrame, *, force: bool = False) -> DataFrame:
    """path, action (rebaselined, refused or missing), reason for measured targets with missing, internal, read_error.

    ``previous_status`` is carried if there. Repeated targets count once.
    """
    invalid = F.col("validation.checked") & ~F.col("validation.is_valid")
    action = (
        F.when(F.col("missing"), F.lit("missing"))
        .when(F.col("internal"), F.lit("refused"))
        .when(F.col("read_error").isNotNull(), F.lit("missing"))
        .when(invalid & F.lit(not force), F.lit("refused"))
        .otherwise(F.lit("rebaselined"))
    )
    reason = (
        F.when(F.col("missing"), F.lit("file not found"))
        .when(F.col("internal"), F.lit("internal file"))
        .when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(invalid & F.lit(not force), F.coalesce("validation.error_message", F.lit("format validation failed")))
    )
    return targets.dropDuplicates(["path"]).withColumn("action", action).withColumn("reason", reason)


def rebaselined(baseline: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """The baseline with accepted targets as the new truth: no corruption on record, first_seen kept."""
    new = outcomes.where("action = 'rebaselined'").alias("n")
    both = baseline.alias("o").join(new, F.col("o.file_path") == F.col("n.path"), "full_outer")
    hit = F.col("n.path").isNotNull()
    pick = lambda n, o: F.when(hit, n).otherwise(F.col(f"o.{o}")).alias(o)
    stamp = F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    kind = F.coalesce("n.validation.format_name", formats.format_name("n.ext"))
    return both.select(
        F.coalesce("o.file_path", "n.path").alias("file_path"),
        pick(F.col("n.size_bytes"), "size_bytes"),
        pick(F.col("n.checksum"), "checksum"),
        pick(F.unix_micros(F.col("n.mtime")) / 1e6, "last_modified"),
        pick(F.lit(0), "is_corrupted"),
        pick(F.col("n.shannon_entropy"), "shannon_entropy"),
        pick(kind, "file_type"),
        pick(stamp, "analysis_date"),
        F.coalesce(F.col("o.first_seen"), F.when(hit, F.lit(now))).alias("first_seen"),
        pick(F.lit(None).cast("double"), "first_corrupt"),
        pick(F.lit("NEW_FILE"), "last_status"),
        pick(F.lit(now), "last_seen"),
    )


def requested(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Paths asked for by name, with ``missing`` for those that aren't there."""
    found = paths.select("path").distinct().alias("p").join(files.alias("f"), F.col("p.path") == F.col("f.path"), "left")
    name = F.coalesce("f.name", formats.file_name(F.col("p.path")))
    return found.select(F.col("p.path").alias("path"), name.alias("name"), "f.mtime", "f.content", "f.read_error", F.col("f.path").isNull().alias("missing"))


def vanished(baseline: DataFrame, files: DataFrame) -> DataFrame:
    """Baseline rows without a file. An extension: a directory scan by itself never reports these."""
    return baseline.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")

"""Additive corruption score from byte statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytestats, dimensions, formats

THRESHOLD = 0.55
TERMS = ("entropy", "nulls", "unique", "pattern", "variance", "run", "text")
#: What a file's histogram decides, whatever the order of its bytes.
HISTOGRAM_TERMS = ("entropy", "nulls", "unique", "variance", "text")


def score(files: DataFrame, threshold: float = THRESHOLD, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """path, math_score, confidence, is_corrupted, reasons and the statistics behind them.

    An empty file scores 1; a file that can't be read is corrupt with confidence 0, a missing one with 1.
    Only the ``terms`` named count.
    """
    staged = files.withColumn("ext", formats.extension(F.col("name"))).withColumn("_s", bytestats.byte_statistics(F.col("content")))
    s = F.col("_s")
    n, odd = s["size_bytes"], F.col("ext").isin(dimensions.TEXT) & ((s["high_ratio"] >= 0.30) | (s["low_ratio"] >= 0.10) | (s["null_ratio"] > 0.01))
    long_run = s["max_run"] >= F.greatest(F.lit(64), F.least(F.lit(4096), F.floor(n / 2)))
    every = [
        (s["entropy"] <= 1.0, 0.35, F.format_string("low entropy (%.2f)", s["entropy"])),
        (s["null_ratio"] >= 0.80, 0.45, F.format_string("high null ratio (%.1f%%)", s["null_ratio"] * 100)),
        (s["unique_ratio"] <= 0.10, 0.25, F.format_string("low unique ratio (%.1f%%)", s["unique_ratio"] * 100)),
        (s["pattern_length"] > 0, 0.35, F.format_string("repeating pattern length %d with %d repeats", s["pattern_length"], s["pattern_repeats"])),
        ((s["variance"] <= 10.0) & (n >= 64), 0.15, F.format_string("low variance (%.2f)", s["variance"])),
        (long_run, 0.20, F.format_string("long repeated byte run (%d)", s["max_run"])),
        (odd, 0.25, F.lit("binary-like byte distribution in text file")),
    ]
    counted = [t for name, t in zip(TERMS, every, strict=True) if name in terms]
    total = F.lit(0.0)
    for holds, weight, _ in counted:
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    value = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))
    reasons = F.when(n == 0, F.array(F.lit("empty file"))).otherwise(F.array_compact(F.array(*(F.when(holds, say) for holds, _, say in counted))))
    room = max(threshold, 1 - threshold, 1e-9)
    out = staged.withColumn("math_score", value)
    return out.select(
        "path",
        "math_score",
        F.when(n.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.5 + F.abs(F.col("math_score") - threshold) / room)).alias("confidence"),
        F.coalesce(F.col("math_score") >= threshold, F.lit(True)).alias("is_corrupted"),
        reasons.alias("reasons"),
        F.coalesce(n, F.lit(0)).alias("size_bytes"),
        F.sha2("content", 256).alias("checksum"),
        *(s[c].alias(c) for c in ("entropy", "variance", "null_ratio", "unique_ratio", "high_ratio", "low_ratio", "printable_ratio", "chi_square", "pattern_length", "max_run")),
    )

"""Reports of a scan: text, JSON and exports. Only summaries and the rows to be shown reach the driver."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import summary, views

APPLICATION, VERSION = "fathom", "0.1.0"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def humanise(size: int) -> str:
    x, i = float(max(0, size)), 0
    while x >= 1024 and i < len(UNITS) - 1:
        x, i = x / 1024, i + 1
    return f"{int(x)} B" if not i else f"{x:.2f} {UNITS[i]}"


def result_rows(results: DataFrame) -> DataFrame:
    """The results as they stand in a report: thirteen fields, the validation nested or null."""
    validation = F.when(
        F.col("validation").isNotNull(),
        F.struct(
            F.col("validation.is_valid"), F.col("validation.checked"), F.col("validation.format_name"), F.col("validation.error_message"),
            F.col("validation.details").alias("corruption_details"), F.col("validation.info").alias("format_info"),
        ),
    )
    return results.select(
        F.col("path").alias("file_path"),
        "status",
        "is_corrupted",
        "has_fault",
        "is_warning",
        "warnings",
        "file_type",
        F.col("size_bytes").alias("file_size"),
        "checksum",
        "shannon_entropy",
        F.col("message").alias("error_message"),
        validation.alias("format_validation"),
        F.timestamp_seconds("first_corrupt").alias("first_corrupt_at"),
    )


def _first(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def json_report(results: DataFrame, now: datetime | None = None, quarantine: dict | None = None) -> str:
    """{application, version, generated_at_utc, summary, quarantine, results}; rows stream through the driver one at a time."""
    head = _first(summary.scan_summary(results)) | {"top_file_types": [[r["file_type"], r["n"]] for r in summary.type_histogram(results).limit(10).collect()]}
    rows = result_rows(results).orderBy(F.lower("file_path"), "file_path").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    body = ",\n    ".join(r["j"] for r in rows.toLocalIterator())
    start = json.dumps({"application": APPLICATION, "version": VERSION, "generated_at_utc": (now or datetime.now(UTC)).isoformat(), "summary": head, "quarantine": quarantine}, indent=2)
    return start[:-2] + f',\n  "results": [\n    {body}\n  ]\n}}\n'


def text_report(results: DataFrame, *, verbose: bool = False) -> str:
    """Counts, the ten most frequent types, then the rows to be shown, what was not analysed, and warnings."""
    s = _first(summary.scan_summary(results))
    lines = [
        f"{APPLICATION} scan report",
        "=" * 60,
        f"Total files:          {s['total_files']:,}",
        f"Corrupted files:      {s['corrupted_files']:,} ({s['corruption_rate_percent']:.2f}%)",
        f"Suspected ransomware: {s['suspected_ransomware_files']:,}",
        f"Healthy files:        {s['healthy_files']:,}",
        f"Warnings:             {s['warning_files']:,}",
        f"Not analysed:         {s['unreadable_files']:,}",
        f"Total size:           {humanise(s['total_bytes'])}",
        f"Largest file:         {humanise(s['largest_file_bytes'])}",
        "",
        "File types:",
        *(f"  {r['file_type']}: {r['n']:,}" for r in summary.type_histogram(results).limit(10).collect()),
    ]
    for title, rows in (
        ("All files" if verbose else "Corrupted files", views.shown(results, verbose)),
        ("Not Analysed", results.where("has_fault")),
        ("Warnings", results.where("is_warning AND NOT is_corrupted")),
    ):
        found = [f"  [{r['status']}] {r['path']} ({humanise(r['size_bytes'])}, {r['file_type']})" + (f": {r['message'] or '; '.join(r['warnings'])}" if r["message"] or r["warnings"] else "") for r in views.sorted_by(rows).toLocalIterator()]
        if found:
            lines += ["", f"{title}:", *found]
    return "\n".join(lines) + "\n"


def export_rows(results: DataFrame) -> DataFrame:
    """Rows for an export: the status is only OK or CORRUPTED."""
    return results.select(
        F.col("path").alias("file_path"), F.when(F.col("is_corrupted"), "CORRUPTED").otherwise("OK").alias("status"), "file_type", F.col("size_bytes").alias("file_size"), "checksum", F.col("message").alias("error_message")
    )


def export_json(results: DataFrame) -> str:
    types = {r["file_type"]: r["n"] for r in summary.type_histogram(results, corrupted_only=True).collect()}
    rows = [json.loads(r["j"]) for r in export_rows(results).orderBy("file_path").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    return json.dumps({"summary": _first(summary.scan_summary(results)), "corrupted_type_counts": types, "results": rows}, indent=2) + "\n"


def comparison_text(rows: list[dict]) -> str:
    """Strategies side by side; rows as modular.compare() gives them, with seconds."""
    lines = [f"{'strategy':<10} {'files':>9} {'corrupted':>10} {'rate %':>8} {'seconds':>9} {'files/s':>10}"]
    for r in sorted(rows, key=lambda r: r["strategy"]):
        lines.append(f"{r['strategy']:<10} {r['total_files']:>9} {r['corrupted_files']:>10} {r['corruption_rate']:>8.2f} {r['seconds']:>9.3f} {r['files_per_second']:>10.1f}")
    if rows:
        lines += [
            f"Highest throughput: {max(rows, key=lambda r: r['files_per_second'])['strategy']}",
            f"Fastest: {min(rows, key=lambda r: r['seconds'])['strategy']}",
            "All strategies found the same number of corrupted files." if len({r["corrupted_files"] for r in rows}) == 1 else "Strategies differ in corrupted files.",
        ]
    return "\n".join(lines) + "\n"


def write_output(text: str, path: str | Path | None) -> None:
    """To a file, whose folders are made, or to stdout."""
    if path is None:
        print(text, end="")
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")

"""Command line: scans, comparison of strategies, benchmark, quarantine, restore, rebaseline."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import config_from, load_config_file
from .operators import modular, native, summary
from .operators.validation import library_status
from .plans import report
from .plans.engine import Engine
from .sources.corpus import read_corpus
from .sources.state import written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("fathom", description=__doc__)
    mode = p.add_mutually_exclusive_group(required=True)
    for name in ("scan", "modular-scan", "fast-scan", "native-scan"):
        mode.add_argument(f"--{name}", metavar="DIR")
    mode.add_argument("--library-status", action="store_true")
    mode.add_argument("--list-quarantine", action="store_true")
    mode.add_argument("--restore", metavar="FILE")
    mode.add_argument("--rebaseline", metavar="PATH", nargs="+")
    p.add_argument("--config")
    p.add_argument("--state-dir")
    p.add_argument("--strategy", default="balanced", choices=sorted(modular.STRATEGIES))
    p.add_argument("--compare", action="store_true")
    p.add_argument("--strategies", nargs="+", default=sorted(modular.STRATEGIES), choices=sorted(modular.STRATEGIES))
    p.add_argument("--benchmark", action="store_true")
    p.add_argument("--benchmark-limit", type=int, default=1000)
    p.add_argument("--benchmark-repeats", type=int, default=3)
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--exclude-hidden", action="store_true")
    p.add_argument("--follow-symlinks", action="store_true")
    p.add_argument("--no-deep-validation", action="store_true")
    p.add_argument("--quarantine", action="store_true")
    p.add_argument("--include-restored", action="store_true")
    p.add_argument("--fail-on-findings", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--show-corrupted", type=int, default=20)
    p.add_argument("--output")
    return p


def _engine(spark: SparkSession, args: argparse.Namespace) -> Engine:
    flag = lambda on, value: value if on else None
    config = config_from(
        load_config_file(args.config),
        state_dir=args.state_dir,
        include_hidden=flag(args.exclude_hidden, False),
        follow_symlinks=flag(args.follow_symlinks, True),
        deep_validators=flag(args.no_deep_validation, False),
    )
    return Engine(spark, config)


def run_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    """0; 1 for a bad folder; 2 for corrupted files if --fail-on-findings; 3 if a file could not be analysed."""
    engine = _engine(spark, args)
    try:
        results = engine.scan(args.scan, not args.no_recursive)
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    moved = None
    if args.quarantine:
        paths = [r["path"] for r in results.where("is_corrupted").select("path").toLocalIterator()]
        moved = summary.quarantine_counts(engine.quarantine(paths)).first().asDict()
    report.write_output(report.json_report(results, quarantine=moved) if args.json else report.text_report(results, verbose=args.verbose), args.output)
    s = summary.scan_summary(results).first()
    return 3 if s["unreadable_files"] else 2 if args.fail_on_findings and s["corrupted_files"] else 0


def _timed(files, name: str) -> dict:
    began = time.perf_counter()
    rows = modular.scan(files, name)
    counted = rows.agg(F.count(F.lit(1)).alias("total_files"), F.count_if("is_corrupted").alias("corrupted_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes")).first().asDict()
    seconds = time.perf_counter() - began
    rate = counted["corrupted_files"] / counted["total_files"] * 100 if counted["total_files"] else 0.0
    return {"strategy": name, **counted, "corruption_rate": rate, "seconds": seconds, "files_per_second": counted["total_files"] / seconds, "mb_per_second": counted["total_bytes"] / (1 << 20) / seconds}


def run_modular(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        files = read_corpus(spark, args.modular_scan or args.fast_scan, recursive=not args.no_recursive, include_hidden=not args.exclude_hidden, follow_symlinks=args.follow_symlinks)
        names = list(dict.fromkeys(args.strategies))
        if args.benchmark:
            some = files.orderBy(F.lower("path"), "path").limit(args.benchmark_limit)
            runs = spark.createDataFrame([_timed(some, n) for n in names for _ in range(args.benchmark_repeats)])
            rows = [r.asDict() for r in summary.benchmark_summary(runs).orderBy("strategy").collect()]
            report.write_output(json.dumps(rows, indent=2) + "\n", args.output)
        elif args.compare:
            rows = [_timed(files, n) for n in names]
            report.write_output(json.dumps(rows, indent=2) + "\n" if args.json else report.comparison_text(rows), args.output)
        else:
            name = "fast" if args.fast_scan else args.strategy
            head = _timed(files, name)
            rows = modular.scan(files, name).where("is_corrupted").orderBy(F.lower("path"), "path")
            shown = [r.asDict(recursive=True) for r in rows.limit(args.show_corrupted).collect()]
            more = head["corrupted_files"] - len(shown)
            if args.json:
                report.write_output(json.dumps(head | {"corrupted": shown}, indent=2) + "\n", args.output)
            else:
                lines = [f"{k}: {v}" for k, v in head.items()] + [f"  {r['path']}: {r['error']}" for r in shown] + ([f"  ... and {more} more"] if more > 0 else [])
                report.write_output("\n".join(lines) + "\n", args.output)
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def run_native(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        files = read_corpus(spark, args.native_scan, recursive=not args.no_recursive)
        rows = written(native.duplicate_groups(written(native.analyze(files), "native")), "native")
        head = native.summary(rows).first().asDict() | {"extensions": [[r["ext"], r["n"]] for r in native.extension_ranking(rows).collect()]}
        listed = [r.asDict(recursive=True) for r in rows.where("status <> 'OK'").orderBy("path").toLocalIterator()]
        report.write_output(json.dumps({"summary": head, "files": listed}, indent=2) + "\n", args.output)
        return 2 if args.fail_on_findings and native.has_findings(rows) else 0
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run_rebaseline(engine: Engine, args: argparse.Namespace) -> int:
    """3 if some were accepted and some refused; 1 if any was refused or missing, or there was nothing; else 0."""
    outcomes = engine.rebaseline(args.rebaseline, recursive=not args.no_recursive, force=args.force, dry_run=args.dry_run)
    for r in outcomes.orderBy("path").toLocalIterator():
        print(f"{r['action']}: {r['path']}" + (f" ({r['reason']})" if r["reason"] else ""))
    n = {r["action"]: r["n"] for r in summary.action_counts(outcomes).collect()}
    if n.get("rebaselined") and n.get("refused"):
        return 3
    return 1 if n.get("refused") or n.get("missing") or not n else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.library_status:
        print(json.dumps(library_status(), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.scan:
        return run_scan(spark, args)
    if args.modular_scan or args.fast_scan:
        return run_modular(spark, args)
    if args.native_scan:
        return run_native(spark, args)
    engine = _engine(spark, args)
    if args.rebaseline:
        return run_rebaseline(engine, args)
    if args.restore:
        try:
            print(f"restored: {engine.restore(Path(args.restore))}")
            return 0
        except OSError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    for r in engine.list_quarantine(include_restored=args.include_restored).toLocalIterator():
        print(f"{r['id']}: {r['quarantine_path']} <- {r['original_path']} ({r['reason']}, {r['action_date']})" + (f", restored {r['restored_at']}" if r["restored_at"] else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())

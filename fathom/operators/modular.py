"""Stateless scan strategies: processors as columns, merged to one verdict per file.

A processor is a function from the staged files to a struct<file_type, checksum, is_corrupted, error, details>
column, null where it does not apply; custom ones are given to :func:`scan` alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytestats, dimensions, formats
from .validation import validate

_RESULT = "struct<file_type: string, checksum: string, is_corrupted: boolean, error: string, details: array<string>>"
Processor = Callable[[], Column]


def _result(*, kind=None, checksum=None, corrupt=None, error=None, details=()) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.col("ext") if kind is None else kind).alias("file_type"),
        (F.lit("") if checksum is None else checksum).alias("checksum"),
        (F.lit(False) if corrupt is None else corrupt).alias("is_corrupted"),
        (none if error is None else error).alias("error"),
        F.array_compact(F.array(*details)).cast("array<string>").alias("details") if details else F.array().cast("array<string>").alias("details"),
    ).cast(_RESULT)


def basic(algorithm: str = "sha256", limit: int | None = None) -> Column:
    """Size and digest; a digest of a prefix is marked as such."""
    content = F.col("content")
    digest = bytestats.checksum(content, algorithm) if limit is None else bytestats.sampled_checksum(content, algorithm, limit)
    notes = [F.when(F.length(content) == 0, F.lit("empty file"))]
    if limit is not None:
        notes.append(F.when(F.length(content) > limit, F.lit("checksum is sampled, not full-file")))
    return _result(checksum=digest, details=notes)


def null_pattern(share: float, block: int = 16, sample: int = 16 * 1024) -> Column:
    """Too many NUL bytes in a prefix, else a repeating block."""
    head = F.substring(F.col("content"), 1, max(sample, 3 * block))
    n = F.length(head)
    bytes_ = F.decode(head, "ISO-8859-1")  # a character a byte
    nulls = n - F.length(F.replace(bytes_, F.lit("\0"), F.lit("")))
    ratio = F.try_divide(nulls, n)
    many, blocks = F.coalesce(ratio >= share, F.lit(False)), bytestats.repeating_blocks(F.col("content"), block, max(sample, 3 * block))
    say = F.format_string(f"null ratio %.2f%% >= {share * 100:.0f}%%", ratio * 100)
    error = F.when(many, say).when(blocks, F.lit(f"repeating block pattern detected ({block}-byte blocks)"))
    return _result(corrupt=many | blocks, error=error, details=[F.when(n == 0, F.lit("empty file"))])


def image_header() -> Column:
    hit = formats.has_signature(dimensions.IMAGE_HEADERS, all_of=(".webp",))
    error = F.when(~hit, F.concat(F.lit("invalid "), F.upper(F.substring("ext", 2, 9)), F.lit(" header")))
    return F.when(hit.isNotNull(), _result(corrupt=~hit, error=error))


def text_encoding(sample: int) -> Column:
    """Text that does not decode and has binary marks is corrupt; without marks its encoding is unknown."""
    head, enc, s = F.substring(F.col("content"), 1, sample), F.col(f"_text{sample}.encoding"), F.col(f"_text{sample}.head")
    n = F.length(head)
    control = F.try_divide(s["control_bytes"], s["size_bytes"])
    bad = F.coalesce((s["null_ratio"] >= 0.30) | (control >= 0.10), F.lit(False)) & enc.isNull() & (n > 0)
    error = F.when(bad, F.format_string("undecodable text with binary markers (null %.1f%%, control %.1f%%)", s["null_ratio"] * 100, control * 100))
    note = F.when(n == 0, F.lit("empty file")).when(enc.isNotNull(), F.concat(F.lit("decoded as "), enc)).when(~bad, F.lit("unknown text encoding"))
    return F.when(F.col("ext").isin(dimensions.TEXT), _result(corrupt=bad, error=error, details=[note]))


def structure() -> Column:
    v = F.col("validation")
    notes = [F.when(~v["checked"], F.coalesce(v["info"]["reason"], F.lit("not inspected"))), F.when(v["is_valid"], F.concat(F.lit("validated by "), v["validator"]))]
    return _result(kind=v["format_name"], corrupt=~v["is_valid"], error=F.when(~v["is_valid"], F.coalesce(v["error_message"], F.lit("invalid structure"))), details=notes)


@dataclass(frozen=True)
class Strategy:
    name: str
    processors: tuple[Processor, ...]
    text_sample: int = 0


STRATEGIES = {
    "fast": Strategy("fast", (lambda: basic("md5"), lambda: null_pattern(0.85), structure)),
    "balanced": Strategy("balanced", (lambda: basic("sha256"), image_header, lambda: text_encoding(8 * 1024), lambda: null_pattern(0.80), structure), 8 * 1024),
    "deep": Strategy("deep", (lambda: basic("sha256"), image_header, lambda: text_encoding(32 * 1024), lambda: null_pattern(0.75, 32, 32 * 1024), structure), 32 * 1024),
}


def custom(processors: Sequence[Processor], name: str = "custom", *, has_basic: bool = False) -> Strategy:
    """A strategy of one's own; a sha256 processor comes first unless one is there."""
    if not processors:
        raise ValueError("a strategy needs at least one processor")
    return Strategy(name, (*(() if has_basic else (lambda: basic("sha256"),)), *processors), 8 * 1024)


def strategy(name: str | Strategy) -> Strategy:
    if isinstance(name, Strategy):
        return name
    if name.lower() not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name.lower()]


def _staged(files: DataFrame, plans: Sequence[Strategy]) -> DataFrame:
    """The files with their validation and, for each text sample that the strategies take, its encoding and statistics."""
    staged = validate(files.withColumn("ext", formats.extension(F.col("name"))))
    for n in sorted({p.text_sample for p in plans if p.text_sample}):
        head = F.when(F.col("ext").isin(dimensions.TEXT), F.substring("content", 1, n))
        staged = staged.withColumn(f"_text{n}", F.struct(formats.text_encoding(head).alias("encoding"), bytestats.byte_statistics(head).alias("head")))
    return staged


def scan(files: DataFrame, how: str | Strategy = "balanced") -> DataFrame:
    """path, strategy, file_size, file_type, checksum, is_corrupted, error, details of each file.

    Corrupt if any processor says so; the first checksum, the last file type; errors joined once each.
    """
    plan = strategy(how)
    staged = _staged(files, [plan])
    if plan.text_sample:  # what processors of one's own may look at
        staged = staged.withColumn("_encoding", F.col(f"_text{plan.text_sample}.encoding")).withColumn("_head", F.col(f"_text{plan.text_sample}.head"))
    names = [f"_p{i}" for i in range(len(plan.processors))]
    for n, p in zip(names, plan.processors, strict=True):
        staged = staged.withColumn(n, p())
    results = F.filter(F.array(*names), lambda r: r.isNotNull())
    field = lambda f: F.transform(results, lambda r: r[f])
    broken = F.col("read_error").isNotNull()
    kinds = F.filter(field("file_type"), lambda t: t != "")
    sums = F.filter(field("checksum"), lambda c: c != "")
    errors = F.array_distinct(F.filter(F.transform(field("error"), lambda e: F.trim(e)), lambda e: e != ""))
    read = F.concat(F.lit("read failed: "), F.col("read_error"))
    return staged.select(
        "path",
        F.lit(plan.name).alias("strategy"),
        F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("file_size"),
        F.when(broken, F.col("ext")).otherwise(F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.col("ext"))).alias("file_type"),
        F.when(broken, F.lit("")).otherwise(F.coalesce(F.try_element_at(sums, F.lit(1)), F.lit(""))).alias("checksum"),
        (broken | reduce(or_, (F.coalesce(F.col(n)["is_corrupted"], F.lit(False)) for n in names))).alias("is_corrupted"),
        F.when(broken, read).otherwise(F.when(F.size(errors) > 0, F.array_join(errors, "; "))).alias("error"),
        F.when(broken, F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(field("details")))).alias("details"),
    )


def compare(files: DataFrame, names: Sequence[str] = ("fast", "balanced", "deep")) -> DataFrame:
    """Per strategy: files, corrupted, bytes, corruption rate; and whether all found the same number."""
    plans = [strategy(n) for n in dict.fromkeys(names)]
    staged = _staged(files, plans)  # once for all strategies
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    corrupt = lambda p: F.col("read_error").isNotNull() | reduce(or_, (F.coalesce(f()["is_corrupted"], F.lit(False)) for f in p.processors))
    flags = staged.select(size.alias("size"), *(corrupt(p).alias(f"c{i}") for i, p in enumerate(plans)))
    total = flags.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), *(F.count_if(f"c{i}").alias(f"c{i}") for i in range(len(plans))))
    rows = F.explode(F.array(*(F.struct(F.lit(p.name).alias("strategy"), F.col(f"c{i}").alias("corrupted_files")) for i, p in enumerate(plans))))
    each = total.select(rows.alias("r"), "total_files", "total_bytes").select("r.strategy", "total_files", "r.corrupted_files", "total_bytes")
    one = each.agg((F.countDistinct("corrupted_files") == 1).alias("consistent"))
    # one row beside a row per strategy
    return each.crossJoin(F.broadcast(one)).withColumn("corruption_rate", F.coalesce(F.try_divide(F.col("corrupted_files") * 100.0, F.col("total_files")), F.lit(0.0)))

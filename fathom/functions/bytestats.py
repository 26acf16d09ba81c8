"""Byte statistics of binary columns, all in one Arrow pass.

Histograms and what follows from them need every byte once; exploding bytes into rows would multiply the
data by its length. A batch's bytes are one array, so rows are counted many at a time. Digests stay with the JVM's built-ins where those exist.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, TAIL = 16 * 1024, 4 * 1024
#: Repeating-pattern search: lengths up to this, this many repeats, this share of the sample.
MAX_PATTERN, MIN_REPEATS, MIN_COVERAGE = 32, 3, 0.60

_LONGS = ("size_bytes", "null_bytes", "printable_bytes", "high_bytes", "low_bytes", "control_bytes", "unique_bytes", "max_run", "pattern_length", "pattern_repeats")
_DOUBLES = ("entropy", "variance", "chi_square", "null_ratio", "printable_ratio", "high_ratio", "low_ratio", "unique_ratio", "pattern_coverage", "tail_zero_ratio")
STATS = T.StructType([*(T.StructField(n, T.LongType()) for n in _LONGS), *(T.StructField(n, T.DoubleType()) for n in _DOUBLES)])
#: Bytes of rows that are counted together; a larger row is counted alone, piece by piece.
_GROUP = 1 << 20

_BYTE = np.arange(256)
_PRINTABLE = ((_BYTE >= 32) & (_BYTE <= 126)) | np.isin(_BYTE, (9, 10, 13))
_CONTROL = (_BYTE < 9) | ((_BYTE > 13) & (_BYTE < 32))


def repeating_pattern(sample: bytes) -> tuple[int, int, float]:
    """(length, repeats, coverage) of the shortest prefix that repeats often enough; zeros if none does."""
    n = len(sample)
    for length in range(1, min(MAX_PATTERN, n // MIN_REPEATS) + 1):
        x = np.frombuffer(sample, np.uint8)
        same = x[length:] == x[:-length]
        streak = len(same) if same.all() else int(np.argmin(same))
        repeats = 1 + streak // length
        if repeats >= MIN_REPEATS and repeats * length / n >= MIN_COVERAGE:
            return length, repeats, repeats * length / n
    return 0, 0, 0.0


def repeats_blocks(sample: bytes, block: int, least: int = 3) -> bool:
    """Whether all full blocks of a sample are equal, and there are enough of them."""
    n = len(sample) // block
    return n >= least and sample[: n * block] == sample[:block] * n


def _histograms(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each byte value in the rows x[offsets[i] : offsets[i + 1]]."""
    n = len(offsets) - 1
    out = np.zeros((n, 256), np.int64)
    if n == 1:  # of any size
        for at in range(0, len(x), _GROUP):
            out[0] += np.bincount(x[at : at + _GROUP], minlength=256)
        return out
    row = np.repeat(np.arange(n, dtype=np.int64) * 256, np.diff(offsets))
    for at in range(0, len(x), _GROUP):
        part = row[at : at + _GROUP] + x[at : at + _GROUP]
        low, high = int(part[0]) // 256, int(part[-1]) // 256 + 1
        out[low:high] += np.bincount(part - low * 256, minlength=(high - low) * 256).reshape(-1, 256)
    return out


def _longest_runs(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The longest run of one byte value in each row."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(full):
        new = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        new[offsets[:-1][full]] = True
        begins = np.flatnonzero(new)
        out[full] = np.maximum.reduceat(np.diff(np.append(begins, len(x))), np.searchsorted(begins, offsets[:-1][full]))
    return out


def _may_repeat(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose beginning is two equal pieces of some length up to MAX_PATTERN: others have no repeating pattern."""
    size = np.diff(offsets)
    at = offsets[:-1, None] + np.arange(2 * MAX_PATTERN)
    head = x[np.minimum(at, max(0, len(x) - 1))] if len(x) else np.zeros((len(size), 2 * MAX_PATTERN), np.uint8)
    out = np.zeros(len(size), bool)
    for length in range(1, MAX_PATTERN + 1):
        out |= (size >= MIN_REPEATS * length) & (head[:, :length] == head[:, length : 2 * length]).all(axis=1)
    return out


def _grouped(x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of the rows of one buffer, columnwise."""
    n, h = np.diff(offsets), _histograms(x, offsets)
    some = np.maximum(n, 1)
    p = h / some[:, None]
    entropy = np.maximum(0.0, -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1))
    mean, square = h @ _BYTE / some, h @ (_BYTE * _BYTE) / some
    expected = some[:, None] / 256
    out = {
        "size_bytes": n, "null_bytes": h[:, 0], "printable_bytes": h[:, _PRINTABLE].sum(axis=1), "high_bytes": h[:, 128:].sum(axis=1), "low_bytes": h[:, 1:32].sum(axis=1),
        "control_bytes": h[:, _CONTROL].sum(axis=1), "unique_bytes": (h > 0).sum(axis=1), "max_run": _longest_runs(x, offsets),
        "entropy": entropy, "variance": np.where(n > 1, np.maximum(0.0, square - mean * mean), 0.0), "chi_square": np.where(n > 0, ((h - expected) ** 2 / expected).sum(axis=1), 0.0),
    }
    out |= {k.replace("_bytes", "_ratio"): out[k] / some for k in ("null_bytes", "printable_bytes", "high_bytes", "low_bytes")}
    out["unique_ratio"] = out["unique_bytes"] / np.minimum(256, some)
    found = np.zeros((len(n), 3))
    for i in np.flatnonzero(_may_repeat(x, offsets)):
        found[i] = repeating_pattern(x[offsets[i] : min(offsets[i + 1], offsets[i] + HEAD)].tobytes())
    out |= {"pattern_length": found[:, 0].astype(np.int64), "pattern_repeats": found[:, 1].astype(np.int64), "pattern_coverage": found[:, 2]}
    tail = np.minimum(n, TAIL)
    zeros = np.array([k - np.count_nonzero(x[end - k : end]) for end, k in zip(offsets[1:], tail, strict=True)], np.int64)
    out["tail_zero_ratio"] = zeros / np.maximum(tail, 1)
    return out


def statistics(data: bytes) -> dict:
    """All statistics of one value."""
    found = _grouped(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return {k: found[k][0].item() for k in (*_LONGS, *_DOUBLES)}


def _columns(content: pa.Array) -> pa.StructArray:
    """statistics() of a binary array, a few rows of about _GROUP bytes at a time."""
    raw = content.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    x = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), max(at + 1, int(np.searchsorted(offsets, offsets[at] + _GROUP, "right")) - 1))
        parts.append(_grouped(x[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        at = to
    kinds = [*((n, pa.int64()) for n in _LONGS), *((n, pa.float64()) for n in _DOUBLES)]
    arrays = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, kind in kinds]
    return pa.StructArray.from_arrays(arrays, [k for k, _ in kinds], mask=raw.is_null())


@F.arrow_udf(STATS)
def byte_statistics(content: pa.Array) -> pa.Array:
    """statistics() of a binary column; null stays null."""
    return _columns(content)


# Otherwise the optimizer may copy the call into each filter and column made from its result.
byte_statistics = byte_statistics.asNondeterministic()


def repeating_blocks(content: Column, block: int, sample: int = HEAD, least: int = 3) -> Column:
    """repeats_blocks() of a prefix, in the JVM."""
    head = F.substring(content, 1, sample)
    n = F.floor(F.length(head) / F.lit(block)).cast("int")
    full = F.substr(head, F.lit(1), n * block)
    return (n >= least) & (F.hex(full) == F.repeat(F.hex(F.substring(head, 1, block)), n))


def checksum(content: Column, algorithm: str) -> Column:
    """Hex digest; the JVM's functions where it has them, any hashlib name else."""
    name = algorithm.lower().replace("-", "")
    native = {"sha256": F.sha2(content, 256), "sha512": F.sha2(content, 512), "sha384": F.sha2(content, 384), "sha224": F.sha2(content, 224), "md5": F.md5(content), "sha1": F.sha1(content)}
    if name in native:
        return native[name]
    hashlib.new(algorithm)  # an unknown name fails here and not in a task

    @F.arrow_udf(T.StringType())
    def digest(values: pa.Array) -> pa.Array:
        return pa.array([None if v.as_py() is None else hashlib.new(algorithm, v.as_py()).hexdigest() for v in values], pa.string())

    return digest(content)


def sampled_checksum(content: Column, algorithm: str, limit: int) -> Column:
    """Digest of the first ``limit`` bytes, marked ``sampled:`` where there are more."""
    head = checksum(F.substring(content, 1, limit), algorithm)
    return F.when(F.length(content) > limit, F.concat(F.lit("sampled:"), head)).otherwise(head)


def chi_square(observed: Column, expected: Column) -> Column:
    """Of two arrays of counts; terms without an expectation are skipped, arrays must be of one length."""
    terms = F.zip_with(observed, expected, lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(F.lit(0.0)))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(F.size(observed) == F.size(expected), total).otherwise(F.raise_error(F.lit("observed and expected differ in length")).cast("double"))

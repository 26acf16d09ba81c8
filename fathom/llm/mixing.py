"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed pseudo-random order, are cut into blocks of BLOCK_CHARS characters. With
w of every D slots due to a source, its block i may not run before slot floor(i D / w) and must run before
slot ceil((i + 1) D / w); earliest deadline first then meets every deadline, so at any slot each source is
less than one block away from its exact share.

The weights are whole numbers of slots, so the schedule repeats after D slots with all deviations back at
zero. One period is simulated and every block finds its slot by arithmetic: nothing in the schedule is sequential
in the size of the corpus. The driver lays out up to MAX_SLOTS slots in all; where many sources run out one after
another and take more, tasks lay out the stretches between, and blocks are joined with theirs. When a source runs out, one
shorter period takes its last blocks and the others go on with the weights that are left, so every document
is placed. A change of weights falls where all deviations are zero.

Defined results: a null source is the source ``''``; a null or empty text has no characters and shares the
block of what stands before it; an empty table gives an empty result; rows with the same id keep a row each.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

BLOCK_CHARS = 1 << 16
SLOTS = 1000
MAX_SLOTS = 1 << 20
BUCKET_ROWS = 1024
#: Without given weights a source's weight is its size to this power: 1 is as it comes, 0 all alike.
TEMPER = 0.5


def whole_slots(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Weights as whole slots of a period, by largest remainders, one at least; ties by name."""
    names = sorted(s for s, w in weights.items() if w > 0)
    slots = max(slots, len(names))
    total = sum(weights[s] for s in names)
    spare = slots - len(names)
    exact = {s: weights[s] / total * slots for s in names}
    over = {s: max(0.0, exact[s] - 1) for s in names}
    scale = spare / sum(over.values()) if sum(over.values()) else 0
    out = {s: 1 + int(over[s] * scale) for s in names}
    left = slots - sum(out.values())
    for s in sorted(names, key=lambda s: (-(over[s] * scale - int(over[s] * scale)), s))[:left]:
        out[s] += 1
    return out


def one_period(slots: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in a period, earliest deadline first among the released blocks."""
    d = sum(slots.values())
    waiting = [(0, -(-d // w), s, 0) for s, w in sorted(slots.items()) if w]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in slots}
    for slot in range(d):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        assert slot < deadline
        out[s].append(slot)
        w = slots[s]
        if i + 1 < w:
            heapq.heappush(waiting, ((i + 1) * d // w, -(-(i + 2) * d // w), s, i + 1))
    return out


def stretches(blocks: np.ndarray, slots: np.ndarray):
    """Yields (base slot, periods, sources, their slots in a period, their first blocks) of the schedule's stretches.

    A stretch goes on until a source runs out of whole periods; one short period then takes what that source has left.
    """
    left, base = blocks.astype(np.int64), 0
    while (live := np.flatnonzero(left)).size:
        shares = slots[live]
        whole = int((left[live] // shares).min())
        if not whole:
            shares, whole = np.minimum(shares, left[live]), 1
        yield base, whole, live, shares, blocks[live] - left[live]
        left[live] -= whole * shares
        base += whole * int(shares.sum())


def _laid_out(names: list[str], base: int, whole: int, live: np.ndarray, shares: np.ndarray, firsts: np.ndarray):
    """(source, stretch) of each source in a stretch."""
    places = one_period({names[i]: int(w) for i, w in zip(live, shares, strict=True)})
    d = int(shares.sum())
    for i, w, first in zip(live.tolist(), shares.tolist(), firsts.tolist(), strict=True):
        yield names[i], {"first": first, "last": first + whole * w, "w": w, "period": d, "base": base, "places": places[names[i]]}


def plan(blocks: Mapping[str, int], slots: Mapping[str, int]) -> dict[str, list[dict]]:
    """Per source the stretches of its blocks: first, last (exclusive), w, period, base slot, places in a period."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    out: dict[str, list[dict]] = {s: [] for s in names}
    for stretch in stretches(*_vectors(names, blocks, slots)):
        for s, x in _laid_out(names, *stretch):
            out[s].append(x)
    return out


def _vectors(names: list[str], blocks: Mapping[str, int], slots: Mapping[str, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([blocks[s] for s in names], np.int64), np.array([slots[s] for s in names], np.int64)


def _stretch_rows(names: list[str], blocks: np.ndarray, slots: np.ndarray):
    def run(batches):
        """The stretches of the given numbers; a task goes through the plan once and lays out only its own."""
        mine = {k for batch in batches for k in batch.column(0).to_pylist()}
        for k, stretch in enumerate(stretches(blocks, slots) if mine else ()):
            if k in mine:
                rows = list(_laid_out(names, *stretch))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows]), pa.array([x for _, x in rows], _STRETCH)], ["source", "x"])

    return run


def _placed_blocks(spark: SparkSession, names: list[str], blocks: np.ndarray, slots: np.ndarray, n: int) -> DataFrame:
    """(source, block, x) of every block, x its stretch, from stretches that tasks lay out."""
    numbers = spark.range(n).repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    laid = numbers.mapInArrow(_stretch_rows(names, blocks, slots), f"source string, x {_STRETCH_SQL}")
    each = laid.select("source", "x", F.explode(F.sequence(F.col("x.first"), F.col("x.last") - 1)).alias("block"))
    # of the places only the block's own
    i = ((F.col("block") - F.col("x.first")) % F.col("x.w")).cast("int")
    own = F.col("x").withField("places", F.array(F.get("x.places", i))).withField("place", F.get("x.places", i))
    return each.select("source", "block", own.alias("x"))


_STRETCH_SQL = "struct<first: bigint, last: bigint, w: bigint, period: bigint, base: bigint, places: array<int>>"
_STRETCH = pa.struct([*((c, pa.int64()) for c in ("first", "last", "w", "period", "base")), ("places", pa.list_(pa.int32()))])
_PLAN = f"source string, stretches array<{_STRETCH_SQL}>"


def blocks_of(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows' doc_id, source, n_chars, and the start and block of each in its source.

    Running sums over a source of any size: rows fall into small buckets, a window runs inside a bucket,
    and another over the buckets' sums.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"),
    )
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(rows, "rows")  # three small columns; the texts are read once
    buckets = max(1, rows.count() // BUCKET_ROWS)
    h = F.xxhash64("doc_id", "n_chars")
    rows = rows.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_chars").alias("chars")).withColumn("upper", F.floor(F.col("bucket") / F.lit(BUCKET_ROWS)))
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    # running sums of buckets inside an upper bucket, and of the upper buckets: a millionth of the rows
    uppers = sums.groupBy("source", "upper").agg(F.sum("chars").alias("chars"))
    uppers = uppers.select("source", "upper", F.coalesce(F.sum("chars").over(before("source").orderBy("upper")), F.lit(0)).alias("base"))
    inner = sums.withColumn("at", F.coalesce(F.sum("chars").over(before("source", "upper").orderBy("bucket")), F.lit(0)))
    starts = inner.join(uppers, ["source", "upper"]).select("source", "bucket", (F.col("at") + F.col("base")).alias("at"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n_chars").over(inside), F.lit(0))).join(starts, ["source", "bucket"])
    start = F.col("at") + F.col("before")
    return placed.select("doc_id", "source", "n_chars", start.alias("start"), F.floor(start / F.lit(block_chars)).alias("block"))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, *, block_chars: int = BLOCK_CHARS, slots: int = SLOTS, max_slots: int = MAX_SLOTS) -> DataFrame:
    """doc_id, source, n_chars, start, block, slot, release, deadline of every row.

    Without ``weights`` they follow the sources' sizes to the power TEMPER. A source without a weight,
    or with none above zero, is not left out: it counts as the smallest given weight.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(blocks_of(docs, block_chars), "blocks")
    sizes = {r["source"]: (r["chars"], r["blocks"]) for r in rows.groupBy("source").agg(F.sum("n_chars").alias("chars"), (F.max("block") + 1).alias("blocks")).collect()}  # a row a source
    if weights is None:
        target = {s: max(1, chars) ** TEMPER for s, (chars, _) in sizes.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        target = {s: w if (w := weights.get(s, 0)) > 0 else least for s in sizes}
    names = sorted(sizes)
    counts, shares = {s: n for s, (_, n) in sizes.items()}, whole_slots(target, slots) if sizes else {}
    vectors = _vectors(names, counts, shares)
    lengths = [int(w.sum()) for _, _, _, w, _ in stretches(*vectors)]
    if sum(lengths) <= max_slots:
        # so many places at most, hence small enough to broadcast
        table = F.broadcast(docs.sparkSession.createDataFrame(list(plan(counts, shares).items()), _PLAN))
        found = F.filter("stretches", lambda x: (F.col("block") >= x["first"]) & (F.col("block") < x["last"]))[0]
        joined = rows.join(table, "source").withColumn("x", found)
        joined = joined.withColumn("place", F.get("x.places", ((F.col("block") - F.col("x.first")) % F.col("x.w")).cast("int")))
    else:
        joined = rows.join(_placed_blocks(docs.sparkSession, names, *vectors, len(lengths)), ["source", "block"]).withColumn("place", F.col("x.place"))
    k = F.col("block") - F.col("x.first")
    i, turn = k % F.col("x.w"), F.floor(k / F.col("x.w"))
    begin = F.col("x.base") + turn * F.col("x.period")
    return joined.select(
        "doc_id",
        "source",
        "n_chars",
        "start",
        "block",
        (begin + F.col("place")).cast("long").alias("slot"),
        (begin + F.floor(i * F.col("x.period") / F.col("x.w"))).cast("long").alias("release"),
        (begin + F.ceil((i + 1) * F.col("x.period") / F.col("x.w"))).cast("long").alias("deadline"),
    )


#: The column by which :func:`mixed` names the places of its rows, for stages that lay rows out anew.
PLACE = "mixing_place"


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, *, block_chars: int = BLOCK_CHARS, slots: int = SLOTS, place: str | None = None) -> DataFrame:
    """All rows with all their columns, laid out in the order of the schedule (part by part, row by row).

    With ``place`` a long column of that name is added, which orders the rows as the schedule does: the
    slot times block_chars, and the row's start in its block.
    """
    slot, start, key = (fresh(c, docs.columns) for c in ("slot", "start", "key"))
    placed = schedule(docs, weights, block_chars=block_chars, slots=slots)
    order = placed.groupBy("doc_id", "source").agg(F.min(F.struct("slot", "start")).alias("at")).select(F.struct("doc_id", "source").alias(key), F.col("at.slot").alias(slot), F.col("at.start").alias(start))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    joined = docs.withColumn(key, own).join(order, key, "left")
    at = [] if place is None else [(F.col(slot) * block_chars + F.col(start) % block_chars).alias(place)]
    return joined.repartitionByRange(F.col(slot), F.col(start)).sortWithinPartitions(slot, start).select(*docs.columns, *at)

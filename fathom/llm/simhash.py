"""SimHash near-duplicate detection with vantage-point trees over fingerprints.

A fingerprint is one or more 64-bit SimHash words over a text's word shingles. Finding all pairs
within a Hamming radius goes in three steps:

1. Equal fingerprints collapse to one row (partial aggregation, so copies cost no shuffle).
2. Shards. The bits are split into blocks. A pair within the radius has a block whose own distance is
   at most r = radius // blocks, so each block gets a vantage-point partition of its own: the distances
   of the block to fixed vantage points name a cell. By the triangle inequality, a partner's distances
   lie within r of these, so a fingerprint lives in its own cell and is a query in each cell that its
   ball of radius r overlaps. With r = 0, the production setting, the ball lies inside one cell.
3. Inside a shard, fingerprints are compared in full. Small shards are compared row by row; larger
   ones through a vantage-point tree that skips a branch when |d(q, v) - mu| rules it out.
   Shards above TILE rows are cut into tiles, and each pair of tiles is a task's work on its own, so a
   hot cell is never gathered in one place and none of its pairs is lost.

A shard gives a spanning forest of what it links, never all pairs of a group.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh
from .components import components, local_roots

SEED = 42
VANTAGE = 8
#: Fingerprints that one is compared with at most, were they random.
COMPARED = 1024
TILE = 8192
_LEAF = 64


# ---- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of every shingle of ``size`` words, repeats included.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, joined by one space; a text of
    fewer words has its whole sequence as the only shingle, an empty one has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n < 2:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of further hash bits (k = 0: the hash itself)."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int = 3, words: int = 1) -> list[int]:
    """``words`` 64-bit words; a bit is 1 if set in over half of the shingle hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return [0] * words
    out = []
    for k in range(words):
        bits = np.unpackbits(_mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little"))
    return out


def fingerprint_column(text: str, size: int = 3, words: int = 1) -> Column:
    """array<long> of the fingerprint's words (as signed longs)."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashed(texts: pa.Array) -> pa.Array:
        flat = np.array([fingerprint(t.as_py(), size, words) for t in texts], np.uint64).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32)), pa.array(flat.view(np.int64)))

    return hashed(F.col(text).cast("string"))


# ---- vantage points -------------------------------------------------------------------------


def vantage_points(width: int, n: int = VANTAGE) -> list[int]:
    """Fixed vantage points of a block of ``width`` bits."""
    rng = np.random.default_rng(20_000 + width)
    return [int(x) for x in rng.integers(0, 1 << min(width, 62), n)]


def rings(block: Column, width: int, n: int) -> list[Column]:
    """The block's distances to its vantage points."""
    return [F.bit_count(block.bitwiseXOR(F.lit(v).cast("long"))) for v in vantage_points(width, n)]


def cells(fp: str, bits: int, blocks: int, slack: int, equal: int = 1) -> Column:
    """array<long> of the cells, over all choices of ``equal`` blocks, that a fingerprint's balls of radius ``slack`` overlap."""
    # the more a ball overlaps, the fewer vantage points pay: each multiplies the cells by 2 slack + 1
    n = VANTAGE if slack == 0 else max(1, 4 // (2 * slack))
    edges = [b * bits // blocks for b in range(blocks + 1)]
    each = []
    for b, (at, to) in enumerate(zip(edges, edges[1:], strict=False)):
        (at, off), width = divmod(at, 64), to - at
        word = F.shiftrightunsigned(F.col(fp)[at], off)
        if off + width > 64:
            word = word.bitwiseOR(F.shiftleft(F.col(fp)[at + 1], 64 - off))
        block = word.bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))
        own = [F.lit(b).cast("long")]
        for d in rings(block, width, n):
            own = [c * 71 + d + s for c in own for s in range(2 * slack + 1)]
        each.append(own)
    if equal == 1:
        return F.array(*(c for own in each for c in own))
    return F.array(*(F.xxhash64(F.lit(k), *(each[b][0] for b in chosen)) for k, chosen in enumerate(combinations(range(blocks), equal))))


def scheme(rows: int, radius: int = 3, bits: int = 64, most: int = COMPARED) -> tuple[int, int]:
    """(blocks, equal): radius + equal blocks, of which a pair within the radius has ``equal`` alike.

    The fewest of them that leave a fingerprint among so many random ones at most about ``most`` to be compared with.
    """
    equal = 1
    while comparisons(rows, radius + equal, equal, bits) > most and equal < 4:
        equal += 1
    return radius + equal, equal


def comparisons(rows: int, blocks: int, equal: int, bits: int = 64) -> float:
    """How many of so many random fingerprints one is compared with."""
    return math.comb(blocks, equal) * rows / 2.0 ** (bits * equal // blocks)


class VPTree:
    """A vantage-point tree over fingerprints (n x words, uint64) in Hamming distance."""

    def __init__(self, points: np.ndarray):
        self.points, self.visited = points, 0
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, ids: np.ndarray):
        if len(ids) <= _LEAF:
            return ids
        d = hamming(self.points[ids], self.points[ids[0]])
        mu = int(np.median(d))
        near = d <= mu
        if near.all():
            near = d < mu
            mu -= 1
            if not near.any():
                return ids
        return ids[0], mu, self._grow(ids[near]), self._grow(ids[~near])

    def links(self, queries: np.ndarray, radius: int):
        """Yields (query indices, point indices) of all pairs within the radius, a leaf at a time."""
        yield from self._search(self.root, np.arange(len(queries)), queries, radius)

    def _search(self, node, who, queries, radius):
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(who), 1024):
                part = who[at : at + 1024]
                self.visited += len(part) * len(node)
                close = hamming(queries[part][:, None, :], self.points[node][None, :, :]) <= radius
                q, p = np.nonzero(close)
                yield part[q], node[p]
            return
        v, mu, near, far = node
        d = hamming(queries[who], self.points[v])
        yield from self._search(near, who[d - radius <= mu], queries, radius)
        yield from self._search(far, who[d + radius > mu], queries, radius)


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances over the last axis (the words of a fingerprint)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def shard_forest(cell: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of what lies within the radius in each of the shards, given sorted by cell."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    big = sizes > small
    a, b = [], []
    rows = np.flatnonzero(~np.repeat(big, sizes))
    c, f, who, step = cell[rows], fps[rows], ids[rows], 1
    while step < len(c) and (same := np.flatnonzero(c[step:] == c[:-step])).size:
        close = same[hamming(f[same], f[same + step]) <= radius]
        a.append(who[close])
        b.append(who[close + step])
        step += 1
    for s, n in zip(starts[big], sizes[big], strict=True):
        part, own = fps[s : s + n], ids[s : s + n]
        root = np.arange(n)
        for q, p in VPTree(part).links(part, radius):
            if len(q):
                nodes, low = local_roots(np.concatenate([q, np.arange(n)]), np.concatenate([p, root]))
                root[nodes] = low
        a.append(own)
        b.append(own[root])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    keep = x != y
    nodes, low = local_roots(x[keep], y[keep])
    keep = nodes != low
    return nodes[keep], low[keep]


def _forests(radius: int, words: int):
    def run(batches):
        """Rows (cell, fp, id), sorted by cell; a cell may go over the edge of a batch."""
        left = None
        for batch in batches:
            now = (batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, words), batch.column(2).to_numpy())
            if left is not None:
                now = tuple(np.concatenate(x) for x in zip(left, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            left = tuple(x[cut:] for x in now)
            if cut:
                yield _edges(*(x[:cut] for x in now), radius)
        if left is not None and len(left[0]):
            yield _edges(*left, radius)

    return run


def _edges(cell, fps, ids, radius):
    a, b = shard_forest(cell, fps, ids, radius)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# ---- the operator ---------------------------------------------------------------------------


def links(prints: DataFrame, scratch: Scratch, *, radius: int = 3, blocks: int = 4, words: int = 1, slack: int | None = None, equal: int = 1, tile: int = TILE) -> DataFrame:
    """A spanning forest (a, b) of the pairs of distinct fingerprints (id long, fp array<long>) within the radius.

    With ``slack`` left out (radius // blocks) every pair is found. A smaller slack finds the pairs that
    have a block with at most that distance. Cells of several ``equal`` blocks need that many more than the radius.
    """
    slack = radius // (blocks - equal + 1) if slack is None else slack
    if equal > 1 and slack:
        raise ValueError("cells of several blocks hold no balls: take radius + equal blocks")
    at = prints.select("id", "fp", F.explode(cells("fp", 64 * words, blocks, slack, equal)).alias("cell")).select("cell", "fp", "id")
    hot = scratch.keep(at.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile), "hot")
    if not hot.isEmpty():
        # tile (i, j) of a hot cell holds the fingerprints of salt i and of salt j
        n = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tile)).cast("int")
        salted = at.join(hot, "cell", "left").withColumn("s", n).withColumn("i", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
        tiled = salted.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        at = tiled.select(F.when(F.col("s") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j"))).alias("cell"), "fp", "id")
    parts = at.repartition(F.col("cell")).sortWithinPartitions("cell", "id")
    return parts.mapInArrow(_forests(radius, words), "a long, b long")


def near_duplicates(docs: DataFrame, *, size: int = 3, radius: int = 3, blocks: int | None = None, words: int = 1, slack: int | None = None) -> DataFrame:
    """doc_id, fp (array<long>) and component_id (smallest doc_id reachable through links) of every row.

    Fingerprints within ``radius`` bits are linked; see :func:`links` for ``slack``. Without ``blocks`` their number
    follows that of the fingerprints, as :func:`scheme` has it. A null or empty text
    has fingerprint zero and is linked like any other; rows whose doc_id is repeated keep one row each;
    a null doc_id keeps its row and never names a component that another id is in.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text", size, words).alias("fp")), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    some = distinct.where("id IS NOT NULL")
    blocks, equal = (blocks, 1) if blocks else scheme(some.count(), radius, 64 * words)
    forest = links(some, scratch, radius=radius, blocks=blocks, words=words, slack=slack, equal=equal)
    found = components(scratch.keep(forest, "links"), scratch)  # written first, so that a task has one Python worker at a time
    named = distinct.join(found, distinct["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def candidate_pairs(docs: DataFrame, size: int = 5) -> DataFrame:
    """(a, b), a < b: of the components by fingerprints of ``size``-word shingles, each other member with the smallest."""
    found = near_duplicates(docs, size=size)
    return found.where("component_id < doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that name their own component, with all their columns; one of each group."""
    d, c = fresh("dup_id", docs.columns), fresh("dup_of", docs.columns)
    first = groups.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(d), F.col("component_id").alias(c)).distinct()
    return docs.join(first, docs["doc_id"] == F.col(d), "left_anti")

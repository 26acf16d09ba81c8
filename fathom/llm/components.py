"""Connected components of an edge table, distributed, by alternating large and small stars.

Edges are first contracted inside each partition (a union-find over that partition's edges only),
which shortens long chains before anything is shuffled. Every round then writes its edges to the
shared folder, so lineage stays short. Once a count shows that what is left fits into one task by far,
that task finishes it. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of a small edge list, by pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(batches):
    """The edges of a partition as stars; a batch at a time, so memory stays with the forest."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        nodes, roots = local_roots(a, b)
        keep = nodes != roots
        a, b = nodes[keep], roots[keep]
        if len(a) > 2_000_000:  # a forest this large moves on as it is; later rounds join the pieces
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            a = b = np.zeros(0, np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: A forest of at most so many edges (16 MB) is finished by one task; larger ones go round by round.
LOCAL_EDGES = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, scratch: Scratch, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): every node of edges (a long, b long) with its component's smallest node.

    Self-loops and repeated edges are fine; an empty edge table gives an empty result.
    """
    now = scratch.keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long"), "forest")
    state = _state(now)
    while state[0] > local_edges:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u points at the smallest node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        after = scratch.keep(small.where("a <> b").distinct(), "stars")
        new = _state(after)
        scratch.drop(now)
        now = after
        if new == state:
            break
        state = new
    else:
        now = scratch.keep(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "stars")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

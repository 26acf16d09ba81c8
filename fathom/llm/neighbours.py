"""Embedding near-duplicates by NN-descent.

1. Equal vectors of one label collapse to a representative (partial aggregation).
2. A first neighbour graph comes from TREES orders of the representatives by random sign codes: what stands
   in one window of an order is compared. Range partitioning cuts a hot label as any other range.
3. NN-descent: around every node, its neighbours and those that name it are compared with one another, and
   lists keep the best. A list that is full of links is saturated: its room doubles for the next round. Rounds go on
   until one joins no more vectors into components. Hubs are dealt in chunks, so that no node's group is unbounded.
4. Links (cosine >= THRESHOLD in double precision) give components; inside each component all links are
   counted exactly, tile against tile, so a full list costs no count.
5. The result is audited: AUDIT_QUERIES representatives, half of them with links, against all vectors, in blocks.
   Below TARGET_RECALL the descent goes on from new orders.

Defined results: vectors that are null, empty, zero or have null or non-finite components, and rows without
a label, link with nothing; vectors of different lengths don't link; repeated rows count as vectors each; a
null id keeps its row. Links between different components that the descent has not seen are lost; the
audit measures how many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD = 0.98
TREES, CODE_BITS, LEAF = 8, 24, 32
K, CHUNK = 8, 24
#: A component is counted in some 16 tiles; a tile holds from 64 to 2048 vectors.
TILES, TILE = 16, (64, 2048)
AUDIT_QUERIES, TARGET_RECALL, MAX_PASSES = 512, 0.99, 3


def _matrix(column, double: bool = False) -> np.ndarray:
    """List column of one length to unit rows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x if double else x.astype(np.float32)


def _by_length(batch, column: int):
    """(batch of one vector length) pieces of a batch."""
    sizes = np.diff(np.asarray(batch.column(column).offsets))
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n)) if len(np.unique(sizes)) > 1 else batch


def _codes(seed: int):
    def run(batches):
        """(tree, grp, code, id, v) for every tree: the signs of CODE_BITS random projections, as a Gray rank."""
        for batch in batches:
            for part in _by_length(batch, 2):
                x = _matrix(part.column(2))
                for tree in range(TREES):
                    rng = np.random.default_rng([seed, tree, x.shape[1]])
                    signs = (x @ rng.standard_normal((x.shape[1], CODE_BITS)).astype(np.float32)) > 0
                    code = signs.astype(np.int64) @ (1 << np.arange(CODE_BITS - 1, -1, -1))
                    for s in (1, 2, 4, 8, 16):  # Gray code to rank: neighbours in rank differ in few signs
                        code ^= code >> s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), tree, np.int32)), part.column(1), pa.array(code), part.column(0), part.column(2)], ["tree", "grp", "code", "id", "v"]
                    )

    return run


def _top(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's k best others: (id, neighbour, similarity)."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sim, best, axis=1).ravel()


def _edge_batch(parts):
    a, b, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep].astype(np.float32))], ["id", "nbr", "sim"])


def _windows(batches):
    """Compares what stands in overlapping windows of LEAF rows of one (tree, grp), rows sorted by code."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
        rows = table.to_batches()[0]
        key = rows.column(0).to_numpy().astype(np.int64) * 1_000_003 ^ rows.column(1).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        parts = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            x, ids = _matrix(rows.column(4).slice(s, e - s)), rows.column(3).slice(s, e - s).to_numpy()
            for at in range(0, max(1, e - s - LEAF // 2), LEAF // 2):
                if len(ids[at : at + LEAF]) > 1:
                    parts.append(_top(ids[at : at + LEAF], x[at : at + LEAF], K))
        if parts:
            yield _edge_batch(parts)
        carry = rows.slice(max(int(cuts[-2]), rows.num_rows - LEAF // 2))


def _local_joins(batches):
    """Compares the members of each group; rows (pivot, chunk, id, worst, v) sorted by pivot and chunk.

    A pair is given to a side whose list it betters.
    """
    carry = None

    def compare(rows):
        vectors = rows.column(4)
        alike = len(np.unique(np.diff(np.asarray(vectors.offsets)))) == 1
        x = _matrix(vectors) if alike else None  # groups have one length each, a batch may have several
        ids, worst = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        key = np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)])
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
        parts = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                a, b, sim = _top(ids[s:e], x[s:e] if alike else _matrix(vectors.slice(s, e - s)), e - s - 1)
                better = sim > np.repeat(worst[s:e], e - s - 1)
                parts.append((a[better], b[better], sim[better]))
        return _edge_batch(parts) if parts else None

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        p, c = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        same = np.flatnonzero((p != p[-1]) | (c != c[-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        carry = rows.slice(cut)
        if cut and (out := compare(rows.slice(0, cut))) is not None:
            yield out
    if carry is not None and carry.num_rows and (out := compare(carry)) is not None:
        yield out


def _best(edges: DataFrame, room: DataFrame | None) -> DataFrame:
    """(id, list, room): each node's best distinct neighbours, as many as it has room for.

    A list whose room was used up by links gets twice the room from now on.
    """
    pairs = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    lists = pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sim", "nbr")), asc=False).alias("list"))
    lists = lists.withColumn("room", F.lit(K)) if room is None else lists.join(room, "id", "left").withColumn("room", F.coalesce("room", F.lit(K)))
    cut = lists.withColumn("list", F.slice("list", F.lit(1), F.col("room")))
    saturated = (F.size("list") >= F.col("room")) & (F.element_at("list", -1)["sim"] >= F.lit(THRESHOLD))
    return cut.withColumn("room", F.when(saturated, F.col("room") * 2).otherwise(F.col("room")))


def _descend(graph: DataFrame, vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """One round: a graph at least as good as the given one."""
    flat = graph.select("id", F.explode("list").alias("e")).select("id", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim"))
    members = flat.select(F.col("id").alias("pivot"), F.col("nbr").alias("id")).union(flat.select(F.col("nbr").alias("pivot"), "id")).distinct()
    chunks = F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int")
    dealt = members.join(members.groupBy("pivot").agg(chunks.alias("chunks")), "pivot")
    dealt = dealt.select("pivot", F.pmod(F.xxhash64("id", "pivot"), F.col("chunks")).cast("int").alias("chunk"), "id")
    full = F.size("list") >= F.col("room")
    worst = F.when(full, F.element_at("list", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float").alias("worst")
    carried = dealt.join(graph.select("id", worst).join(vectors.select("id", "v"), "id"), "id").select("pivot", "chunk", "id", "worst", "v")
    found = carried.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk").mapInArrow(_local_joins, "id long, nbr long, sim float")
    return scratch.keep(_best(flat.union(found), graph.select("id", "room")), "graph")


def _tile_counts(batches):
    """(id, links, linked rows) from pairs of tiles; rows (c, i, j, t, grp, id, n, v) sorted by c, i, j."""
    now, rows = None, []

    def count(key, rows):
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        x, n = _matrix(table.column(7), double=True), table.column(6).to_numpy()
        t, grp, ids = table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(5).to_numpy()
        close = (x @ x.T >= THRESHOLD) & (grp[:, None] == grp)
        if key[1] != key[2]:
            close &= t[:, None] != t
        np.fill_diagonal(close, False)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(close.sum(axis=1, dtype=np.int64)), pa.array(close @ n)], ["id", "links", "linked_rows"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            k = tuple(key[:, s])
            if k != now and rows:
                yield count(now, rows)
                rows = []
            now = k
            rows.append(batch.slice(s, e - s))
    if rows:
        yield count(now, rows)


def _link_counts(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """(id, links, linked_rows) of every representative in a component, exact inside the component."""
    m = F.count(F.lit(1))
    sizes = found.groupBy("component").agg(F.ceil(m / F.greatest(F.lit(TILE[0]), F.least(F.lit(TILE[1]), F.ceil(m / F.lit(TILES))))).cast("int").alias("s"))
    rows = found.join(sizes, "component").join(vectors, found["node"] == vectors["id"])
    tiled = rows.withColumn("t", F.pmod(F.xxhash64("id"), F.col("s")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    tiles = tiled.select("component", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "grp", "id", "n", "v")
    counted = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_tile_counts, "id long, links long, linked_rows long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))


def audit(vectors: DataFrame, counts: DataFrame, queries: int = AUDIT_QUERIES) -> tuple[float | None, int]:
    """Mean over the queries that have links of the share of their links that was found, and how many true links that were.

    Half of the queries are representatives with links found, so that there is something to miss, half are others;
    both by least hash. Every query counts alike, so one large group doesn't hide the small ones. They are held
    against all vectors, in blocks. None if no query has a link.
    """
    linked = counts.where("links > 0").select("id")
    pick = lambda rows: rows.orderBy(F.xxhash64("id"), "id").limit(queries // 2).select("id", "grp", "v").toArrow()  # noqa: E731  a bounded sample
    asked = pa.concat_tables([pick(vectors.join(linked, "id", "left_semi")), pick(vectors.join(linked, "id", "left_anti"))])
    ids, groups, by_length = asked.column("id").to_numpy(), asked.column("grp").to_numpy(), {}
    for i, v in enumerate(asked.column("v").to_pylist()):
        by_length.setdefault(len(v), []).append((ids[i], groups[i], np.array(v, np.float64) / np.linalg.norm(v)))

    def true_links(batches):
        for batch in batches:
            for part in _by_length(batch, 1):
                x, grp = _matrix(part.column(1), double=True), part.column(0).to_numpy()
                if mine := by_length.get(x.shape[1]):
                    close = (x @ np.stack([v for _, _, v in mine]).T >= THRESHOLD) & (grp[:, None] == np.array([g for _, g, _ in mine]))
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in mine], pa.int64()), pa.array(close.sum(axis=0, dtype=np.int64))], ["id", "n"])

    true = {r["id"]: r["n"] - 1 for r in vectors.select("grp", "v").mapInArrow(true_links, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    got = {r["id"]: r["links"] for r in counts.where(F.col("id").isin(ids.tolist())).select("id", "links").collect()}
    shares = [min(1.0, got.get(i, 0) / n) for i, n in true.items() if n > 0]
    return (sum(shares) / len(shares) if shares else None), sum(n for n in true.values() if n > 0)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; the run's audited recall (null without a link) and the links it rests on."""
    scratch = Scratch(rows.sparkSession, "neighbours")
    v = F.col("v")
    sound = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False)
    )
    flat = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    flat = scratch.keep(flat.withColumn("v", F.when(sound, v)), "rows")
    classes = flat.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    vectors = scratch.keep(classes.select("id", F.xxhash64("label", F.size("v")).alias("grp"), "v", "n", "label"), "vectors")
    graph, recall, n_true = None, None, 0
    for attempt in range(MAX_PASSES):
        coded = vectors.select("id", "grp", "v").mapInArrow(_codes(attempt), "tree int, grp long, code long, id long, v array<double>")
        coded = scratch.keep(coded, "codes")
        first = coded.repartitionByRange("tree", "grp", "code", "id").sortWithinPartitions("tree", "grp", "code", "id").mapInArrow(_windows, "id long, nbr long, sim float")
        if graph is not None:
            first = first.union(graph.select("id", F.explode("list").alias("e")).select("id", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim")))
        graph = scratch.keep(_best(first, None if graph is None else graph.select("id", "room")), "graph")
        scratch.drop(coded)
        found, pieces = None, -1
        while True:  # until a round joins nothing more; a saturated list has twice the room in the next
            graph = _descend(graph, vectors, scratch)
            near = graph.select(F.col("id").alias("a"), F.explode("list").alias("e")).where(F.col("e.sim") >= F.lit(THRESHOLD - 1e-5)).select("a", F.col("e.nbr").alias("b"))
            found = scratch.keep(components(_exact(near, vectors), scratch), "found")
            # every joining adds a node or takes away a component
            now = found.agg(F.count(F.lit(1)) - F.countDistinct("component")).first()[0]
            if now == pieces:
                break
            pieces = now
        counts = scratch.keep(_link_counts(vectors, found), "counts")
        recall, n_true = audit(vectors, counts)
        if recall is None or recall >= TARGET_RECALL:
            break
    named = vectors.join(counts, "id", "left").join(found, vectors["id"] == found["node"], "left")
    named = named.select("label", "v", (F.coalesce("linked_rows", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = flat.join(named, ["label", "v"], "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
        F.lit(n_true).cast("long").alias("audited_links"),
    )


def _exact(near: DataFrame, vectors: DataFrame) -> DataFrame:
    """The edges whose cosine in double precision reaches the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _pairs_matrix(batch.column(2)), _pairs_matrix(batch.column(3))
            keep = np.array([len(p) == len(q) and float(p @ q) >= THRESHOLD for p, q in zip(x, y, strict=True)])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    once = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    va, vb = vectors.select(F.col("id").alias("a"), F.col("v").alias("x")), vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    return once.join(va, "a").join(vb, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _pairs_matrix(column) -> list[np.ndarray]:
    out = []
    for v in column.to_pylist():
        x = np.array(v, np.float64)
        out.append(x / np.sqrt(x @ x))
    return out

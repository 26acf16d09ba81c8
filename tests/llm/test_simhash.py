import random

import numpy as np
import pytest
import xxhash

from fathom.llm import simhash
from fathom.llm.common import Scratch

from .odd import documents, empty, rows
from .test_components import brute as union


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_fingerprints_and_components(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    assert len(found) == len(rows())
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    ids = [(i, f) for i, f in fps if i is not None]
    want = union([(a, b) for a, x in ids for b, y in ids if bin(x ^ y).count("1") <= 3 and a < b])
    for r in found:
        if r["doc_id"] is not None:
            assert (r["fp"][0] & (2**64 - 1)) == dict(ids)[r["doc_id"]]
            assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark), simhash.near_duplicates(empty(spark))).count() == 0


def clustered(n, seed=5):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(base)
            base ^= 1 << rng.randrange(64)
    return list(out)[:n]


@pytest.mark.parametrize(("blocks", "tile", "radius"), [(4, 8192, 3), (4, 8, 3), (2, 8192, 3), (1, 8192, 3), (3, 8192, 6)])
def test_links_find_every_pair(spark, blocks, tile, radius):
    fps = clustered(120)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(f)]) for i, f in enumerate(fps)], "id long, fp array<long>")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, Scratch(spark, "t"), radius=radius, blocks=blocks, tile=tile).collect()]
    want = union([(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius])
    assert union(edges) == want


def test_vantage_tree_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    points = (centres[rng.integers(0, 8, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))[:, None]
    tree = simhash.VPTree(points)
    got = {(int(q), int(p)) for a, b in tree.links(points[:200], 3) for q, p in zip(a, b, strict=True)}
    want = {(i, j) for i in range(200) for j in np.flatnonzero(simhash.hamming(points, points[i]) <= 3).tolist()}
    assert {(q, p) for q, p in got if q != p} == {(q, p) for q, p in want if q != p}
    assert tree.visited < 200 * 3000


def test_large_shard_goes_through_the_tree():
    rng = np.random.default_rng(2)
    fps = (np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)))
    fps = np.unique(fps)[:, None]
    ids = np.arange(len(fps))
    a, b = simhash.shard_forest(np.zeros(len(fps), np.int64), fps, ids, 3, small=64)
    c, d = simhash.shard_forest(np.zeros(len(fps), np.int64), fps, ids, 3, small=10_000)
    assert union(list(zip(a.tolist(), b.tolist(), strict=True))) == union(list(zip(c.tolist(), d.tolist(), strict=True)))


@pytest.mark.parametrize("equal", [2, 3])
def test_links_of_several_equal_blocks(spark, equal):
    fps = clustered(150, seed=equal)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(f)]) for i, f in enumerate(fps)], "id long, fp array<long>")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, Scratch(spark, "t"), blocks=3 + equal, equal=equal).collect()]
    assert union(edges) == union([(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])


@pytest.mark.parametrize("rows", [10_000, 10**7, 10**9, 10**11])
def test_comparisons_stay_bounded(rows):
    blocks, equal = simhash.scheme(rows)
    assert blocks == 3 + equal and simhash.comparisons(rows, blocks, equal) <= simhash.COMPARED


def test_measured_comparisons_are_as_foretold():
    """At two sizes: members of shared cells, counted, against the formula."""
    rng = np.random.default_rng(3)
    for n in (20_000, 80_000):
        fps, met = rng.integers(0, 2**64, n, dtype=np.uint64), 0
        for at in range(0, 64, 16):
            met += (np.bincount((fps >> np.uint64(at) & np.uint64(0xFFFF)).astype(np.int64)) ** 2).sum() - n
        assert met / n == pytest.approx(simhash.comparisons(n, 4, 1), rel=0.1)
        assert met / n <= simhash.COMPARED


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = []
    for k in range(20):
        words = [rng.choice(vocabulary) for _ in range(400)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    groups = simhash.near_duplicates(docs)
    got = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert all(got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(20)) and sum(i != c for i, c in got.items()) >= 10
    assert {r["doc_id"] for r in simhash.keep_first(docs, groups).collect()} == {i for i, c in got.items() if i == c}
    pairs = {(r["a"], r["b"]) for r in simhash.candidate_pairs(docs).collect()}
    assert pairs and all(b == a + 1 for a, b in pairs)

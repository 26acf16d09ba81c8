import numpy as np

from fathom.llm import neighbours

from .test_components import brute as union


def table(spark, vectors, extra=()):
    return spark.createDataFrame([*vectors, *extra], "vec_id long, embedding array<float>, label int, id long, v string, grp int")


def clustered(n=300, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 5))):
            out.append((len(out), (base + rng.standard_normal(dim) * 0.06).astype(np.float32).tolist(), int(i % 3), 1, "v", 2))
    tight = rng.standard_normal(dim)
    for _ in range(60):  # more links than a list has room for
        out.append((len(out), (tight + rng.standard_normal(dim) * 0.02).astype(np.float32).tolist(), 0, 1, "v", 2))
    out += [(len(out) + k, out[5][1], out[5][2], 1, "v", 2) for k in range(3)]
    return out


def brute(vectors):
    x = np.array([v[1] for v in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([v[2] for v in vectors])
    close = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    return close.sum(axis=1), union([(int(i), int(j)) for i, j in np.argwhere(np.triu(close))])


def test_links_components_and_audit(spark):
    vectors = clustered()
    odd = [(9001, None, 0, 1, "v", 2), (9002, [0.0] * 16, 0, 1, "v", 2), (9003, [float("nan")] * 16, 0, 1, "v", 2), (9004, [1.0] * 16, None, 1, "v", 2), (9005, [1.0, 2.0], 0, 1, "v", 2), (9006, [], 0, 1, "v", 2), (None, vectors[0][1], 0, 1, "v", 2)]
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(table(spark, vectors, odd)).collect()}
    assert len(got) == len(vectors) + len(odd)
    links, roots = brute(vectors)
    assert [got[i]["n_links"] for i in range(len(vectors))] == links.tolist()
    assert all(got[i]["component_id"] == roots.get(i, i) and got[i]["kept"] == (roots.get(i, i) == i) for i in range(len(vectors)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(9001, 9007))
    assert got[0]["audited_recall"] >= 0.9


def test_vectors_of_several_lengths(spark):
    a, b = clustered(40, 8, 1), clustered(40, 12, 2)
    both = a + [(i + 1000, *rest) for i, *rest in b]
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(table(spark, both)).collect()}
    assert [got[v[0]] for v in both] == brute(a)[0].tolist() + brute(b)[0].tolist()


def test_empty_table(spark):
    assert neighbours.near_duplicates(table(spark, [])).count() == 0

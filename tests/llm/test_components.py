import random

import pytest

from fathom.llm.common import Scratch
from fathom.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("local", [0, 1000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty", "loops"])
def test_components(spark, kind, local):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(1000, i) for i in range(200)],
        "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(300)],
        "empty": [],
        "loops": [(5, 5), (5, 6), (6, 5), (5, 6)],
    }[kind]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test"), local).collect()}
    assert got == brute(edges)

import random

import pytest

from tracewell.operators.iterate import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(3, 2), (2, 3), (3, 2)], [(i, i + 1) for i in range(60)], [(100, i) for i in range(50)], [(None, 1), (2, None)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in components(df).collect()} == brute(edges)


def test_random(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == brute(edges)

"""Betweenness on arrays, held against paths counted one by one."""

import random
from collections import Counter, deque

import pytest

from tracewell.operators import centrality as C


def counted(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    total = Counter(dict.fromkeys(near, 0.0))
    for s in near:
        depth, paths, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        load = Counter()
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    load[v] += paths[v] / paths[w] * (1 + load[w])
            if w != s:
                total[w] += load[w]
    n = len(near)
    return {v: round(x / ((n - 1) * (n - 2)), 9) for v, x in total.items()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_betweenness_of_parted_graphs_beyond_what_python_lists_may_hold(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "MAX_LOCAL_EDGES", 10)
    rng = random.Random(1)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}) + [(100, 101), (101, 102), (200, 201)]
    pairs = [(f"n{a:03d}", f"n{b:03d}") if kind == "string" else (a, b) for a, b in pairs]
    e = spark.createDataFrame([(*p, 1.0) for p in pairs], f"a {kind}, b {kind}, weight double").coalesce(1)
    got = {r.id: r.betweenness for r in C.betweenness(e).collect()}
    assert got == pytest.approx(counted(pairs), abs=2e-9)


def test_betweenness_of_nodes_with_the_same_neighbours(spark):
    rng = random.Random(2)
    hubs = [tuple(rng.sample(range(6), rng.randint(1, 3))) for _ in range(12)]
    pairs = sorted({(h, v) for v in range(100, 160) for h in hubs[v % 12]} | {(0, 1), (100, 500), (500, 501), (600, 601)})
    e = spark.createDataFrame([(*p, 1.0) for p in pairs], "a long, b long, weight double")
    assert {r.id: r.betweenness for r in C.betweenness(e).collect()} == pytest.approx(counted(pairs), abs=2e-9)


def test_every_node_of_a_large_graph_is_a_source(spark):
    """two hubs of 3050 others, of which one has another end."""
    m = 3050
    e = spark.createDataFrame([(h, v, 1.0) for h in (0, 1) for v in range(10, 10 + m)] + [(10, 9000, 1.0)], "a long, b long, weight double")
    got, ends = {r.id: r.betweenness for r in C.betweenness(e).collect()}, (m + 2) * (m + 1)
    assert got[11] == pytest.approx(2 / m / ends, abs=1e-9) and got[9000] == 0
    assert got[10] == pytest.approx((2 * (m + 1) + 2 / m) / ends, abs=1e-9)
    assert got[0] == got[1] == pytest.approx((m * (m - 1) + 2 * (m - 1)) / 2 / ends, abs=1e-9)

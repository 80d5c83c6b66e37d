"""Louvain and articulation points on arrays, beyond what Python lists held."""

import random

import numpy as np
import pytest

from tracewell.operators import centrality as C


def parts(nodes, pairs):
    left, out = set(nodes), 0
    near = {v: set() for v in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    while left:
        todo, out = [left.pop()], out + 1
        while todo:
            new = near[todo.pop()] & left
            left -= new
            todo += new
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cuts_are_nodes_that_part_their_component(spark, kind):
    rng = random.Random(3)
    name = (lambda x: f"n{x:02d}") if kind == "string" else (lambda x: x)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(42)} | {(50, 51)})
    e = spark.createDataFrame([(name(a), name(b), 1.0) for a, b in pairs], f"a {kind}, b {kind}, weight double")
    nodes = {x for p in pairs for x in p}
    whole = parts(nodes, pairs)
    want = {name(v) for v in nodes if any(v not in p for p in pairs) and parts(nodes - {v}, [p for p in pairs if v not in p]) > whole}
    assert {r.id for r in C.articulation_points(e).collect()} == want


def test_communities_of_more_edges_than_lists_held(spark, monkeypatch):
    """F8: arrays are made of 2,100,000 edges; rings of five that a weak link joins to the next are communities."""
    def rings(m):
        at = np.arange(m) * 5
        ring = [(at + i, at + (i + 1) % 5, np.ones(m)) for i in range(5)]
        return [np.concatenate(x) for x in zip(*ring, (at[:-1], at[1:], np.full(m - 1, 1e-3)), strict=True)]

    ids, starts, near, weight = C._compressed(*rings(350_000))
    assert len(near) == len(weight) == 2 * 2_099_999 and len(ids) == len(starts) - 1 == 1_750_000
    assert C.MAX_LOCAL_EDGES > 2_100_000
    got = C._louvain(*rings(40), 1.0)
    assert dict(zip(got["id"].tolist(), got["home"].tolist(), strict=True)).keys() == set(range(200))
    homes = got["home"].reshape(40, 5)
    assert (homes == homes[:, :1]).all()

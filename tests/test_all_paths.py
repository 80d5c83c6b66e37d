"""Simple paths between two nodes, against a search of every path."""

import random

import pytest

from tracewell.operators import paths


def every(pairs, a, b, cutoff):
    near = {}
    for x, y in pairs:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    out, line = [], [[a]]
    while line:
        path = line.pop()
        if path[-1] == b:
            out.append(path)
        elif len(path) <= cutoff:
            line += [path + [n] for n in near.get(path[-1], ()) if n not in path]
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed, cutoff", [(1, 4), (2, 3)])
def test_all_paths(spark, seed, cutoff):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(24)] + [(50, 51)]  # loops, repeats, a part of its own
    e = spark.createDataFrame(pairs, "src long, dst long")
    expect = every(pairs, pairs[0][0], pairs[5][1], cutoff) if pairs[0][0] != pairs[5][1] else []
    assert [r.path for r in paths.all_paths(e, pairs[0][0], pairs[5][1], cutoff, 1000).collect()] == expect
    assert paths.all_paths(e, 50, pairs[0][0], cutoff).collect() == []


def test_distances(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (2, 1), (3, 2), (4, 3), (5, 4)], "src long, dst long")
    assert {tuple(r) for r in paths.distances(e, 1, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert paths.all_paths(spark.createDataFrame([], "src long, dst long"), 1, 1).collect() == []

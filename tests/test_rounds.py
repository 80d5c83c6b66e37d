"""Loops over a graph, held against plain computations on generated graphs."""

import glob
import random

import duckdb
import numpy as np
import pytest

from tracewell.operators import centrality as C
from tracewell.plans import documents, network
from tracewell.sources.storage import shared_dir


def generated(seed, nodes=24, links=50):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(links)})
    return [(a, b, rng.randint(1, 9) / 4) for a, b in pairs]


def frame(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, weight double")


def matrix(rows, n):
    m = np.zeros((n, n))
    for a, b, w in rows:
        m[a, b] += w
        m[b, a] += w
    return m


def parts(nodes, pairs):
    """Sets of joined nodes."""
    left, out = set(nodes), []
    while left:
        group, edge = set(), {min(left)}
        while edge:
            group |= edge
            edge = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in edge and y in left} - group
        left -= group
        out.append(group)
    return out


def test_pagerank_deals_dead_ends_and_lone_nodes(spark):
    links = [(0, 1, 2.0), (0, 2, 1.0), (1, 2, 1.0), (2, 0, 1.0), (0, 3, 1.0), (4, 3, 5.0), (0, 1, 1.0)]  # 3 and 5 pass nothing on
    got = dict(C.pagerank(spark.createDataFrame(links, "src long, dst long, weight double"), tolerance=1e-13, directed=True, nodes=spark.range(6)).collect())
    m = np.zeros((6, 6))
    for a, b, w in links:
        m[a, b] += w
    out = m.sum(1)
    r = np.full(6, 1 / 6)
    for _ in range(300):
        r = 0.15 / 6 + 0.85 * ((np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)).T @ r + r[out == 0].sum() / 6)
    assert [got[i] for i in range(6)] == pytest.approx(r.tolist(), abs=1e-11)


def test_pagerank_of_given_rounds_and_unsettled(spark):
    rows = generated(3)
    e = frame(spark, rows)
    assert sum(r.pagerank for r in C.pagerank(e, iterations=3, tolerance=None).collect()) == pytest.approx(1)
    with pytest.raises(RuntimeError):
        C.pagerank(e, iterations=2, tolerance=1e-15)


def test_empty_graphs_have_no_rows(spark):
    e = frame(spark, [])
    assert C.pagerank(e).collect() == [] and C.eigenvector(e).collect() == [] and C.kcore(e).collect() == []


def test_eigenvector_is_the_leading_one(spark):
    rows = generated(5)
    big = max(parts({x for r in rows for x in r[:2]}, [r[:2] for r in rows]), key=len)
    rows = [r for r in rows if r[0] in big]
    got = dict(C.eigenvector(frame(spark, rows), tolerance=1e-11).collect())
    values, vectors = np.linalg.eigh(matrix(rows, 24))
    lead = np.abs(vectors[:, values.argmax()])
    assert [got[i] for i in sorted(big)] == pytest.approx([lead[i] for i in sorted(big)], abs=1e-7)


def test_eigenvector_of_a_two_sided_graph(spark):
    got = dict(C.eigenvector(frame(spark, [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 1.0)])).collect())
    assert got[0] == pytest.approx(0.5**0.5, abs=1e-6) and got[1] == pytest.approx(8**-0.5, abs=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_core_numbers_by_peeling(spark, seed):
    rows = generated(seed, 20, 70)
    near = {x: {b if a == x else a for a, b, _ in rows if x in (a, b)} for r in rows for x in r[:2]}
    left, core, k = {x: set(v) for x, v in near.items()}, {}, 0
    while left:
        x = min(left, key=lambda y: (len(left[y]), y))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert dict(C.kcore(frame(spark, rows)).collect()) == core


def test_disruption_by_removing_nodes(spark):
    rows = generated(9, 20, 30)
    nodes = sorted({x for r in rows for x in r[:2]})
    degree = {x: sum(x in r[:2] for r in rows) for x in nodes}
    order = {"key_player_targeting": nodes[::-1], "degree_baseline": sorted(nodes, key=lambda x: (-degree[x], x))}
    ranked = spark.createDataFrame([(x, i + 1) for i, x in enumerate(nodes[::-1])], "id long, rank long")
    base = max(map(len, parts(nodes, [r[:2] for r in rows])))
    expect = set()
    for budget in (1, 3, 40):
        for strategy, line in order.items():
            live = set(nodes) - set(line[:budget])
            left = parts(live, [r[:2] for r in rows if r[0] in live and r[1] in live])
            top = max(map(len, left), default=0)
            expect.add((budget, strategy, top, round(100 * top / base, 2), len(left)))
    assert {tuple(r) for r in C.disruption(frame(spark, rows), ranked, (1, 3, 40)).collect()} == expect


def test_rounds_leave_one_table(spark):
    count = lambda: {n: len(glob.glob(f"{shared_dir(spark)}/{n}-*")) for n in ("ranks", "vector", "cores")}
    before, e = count(), frame(spark, generated(7, 8, 20))
    kept = [C.pagerank(e), C.eigenvector(e), C.kcore(e)]
    after = count()
    assert {n: after[n] - before[n] for n in after} == {"ranks": 1, "vector": 1, "cores": 1}
    assert all(k.count() for k in kept)


def test_labels_that_swing_are_told(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)], "a long, b long, weight double")
    got = {r.id: (r.label, r.settled) for r in C.label_propagation(edges, 6).collect()}
    assert {got[k][0] for k in (1, 2, 3)} == {1} and all(got[k][1] for k in (1, 2, 3))
    assert got[7] == (7, False) and got[8] == (8, False)  # after an even number of rounds of taking each other's label
    assert C.label_propagation(edges.limit(0)).count() == 0


def test_pagerank_of_a_two_sided_graph_settles(spark):
    edges = [(hub, 10 + leaf, 1.0) for leaf in range(40) for hub in {leaf % 3, leaf % 4}]
    m = matrix(edges, 50)[np.ix_(*[[i for i in range(50) if not 4 <= i < 10]] * 2)]
    r = np.linalg.solve(np.eye(len(m)) - 0.85 * (m / m.sum(1)[:, None]).T, np.full(len(m), 0.15 / len(m)))
    got = [x.pagerank for x in C.pagerank(frame(spark, edges), tolerance=1e-11).orderBy("id").collect()]
    assert got == pytest.approx(r.tolist(), abs=1e-9)


def test_pagerank_query_has_the_rounds_of_its_sql(spark, tmp_path):
    rows = [(f'{{"k": {hub}}}', 10 + user, 1.0, None, "view", i) for i, (hub, user) in enumerate([(h, u) for u in range(300) for h in {u % 3, u % 7} for _ in range(2)])]
    spark.createDataFrame(rows, "props string, user_id long, value double, ts timestamp_ntz, event_type string, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expect = sorted(con.execute(network.ORACLES["pagerank"]).fetchall())
    assert [tuple(r) for r in network.QUERIES["pagerank"](spark, str(tmp_path)).orderBy("id").collect()] == [(i, pytest.approx(r, abs=1.1e-8)) for i, r in expect]


def test_ego_network_has_all_nodes(spark, tmp_path):
    rows = [('{"k": 120}', 1000 + user, 1.0, None, "view", user) for user in range(10_050) for _ in range(2)]
    spark.createDataFrame(rows, "props string, user_id long, value double, ts timestamp_ntz, event_type string, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert documents.QUERIES["ego_network"](spark, str(tmp_path)).count() == 10_051


def test_eigenvector_rounds_do_not_pass_the_driver(spark, monkeypatch):
    """F16: a round joins the vector to links in buckets without a broadcast, and only the vector is shuffled for it."""
    plans, kept = [], C.measured
    monkeypatch.setattr(C, "measured", lambda df, *a, **k: plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a, **k))
    rows = generated(3)
    got = {r.id: r.eigenvector for r in C.eigenvector(frame(spark, rows)).collect()}
    n = 24
    ids = sorted({x for a, b, _ in rows for x in (a, b)})
    values, vectors = np.linalg.eigh(matrix(rows, n))
    want = np.abs(vectors[:, values.argmax()])
    assert [got[i] for i in ids] == pytest.approx([want[i] for i in ids], abs=1e-5)
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    assert all("Bucketed: true" in p for p in plans[1:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("links_")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rounds_on_arrays_and_in_joins_are_alike(spark, monkeypatch, kind):
    """PageRank and k-core of few edges in one task, of more in joins."""
    name = (lambda x: f"n{x:03d}") if kind == "string" else (lambda x: x)
    e = spark.createDataFrame([(name(a), name(b), w) for a, b, w in generated(4, 20, 40)], f"a {kind}, b {kind}, weight double")
    links = e.select(e.a.alias("src"), e.b.alias("dst"), "weight")
    extra = spark.createDataFrame([(name(900),)], f"id {kind}")
    get = lambda: [{r[0]: r[1] for r in df.collect()} for df in (C.pagerank(e, tolerance=1e-2), C.pagerank(links, 0.9, 4, None, True, extra), C.kcore(e))]
    tasks, found = [], get()
    kept = C._in_one_task
    monkeypatch.setattr(C, "_in_one_task", lambda *a, **k: tasks.append(a) or kept(*a, **k))
    monkeypatch.setattr(C, "MAX_ARRAY_EDGES", 0)
    joined = get()
    assert not tasks
    for one, other, near in zip(found, joined, (1e-10, 1e-10, 0), strict=True):
        assert len(one) > 5 and one == pytest.approx(other, abs=near)

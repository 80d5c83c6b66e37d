import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm import oracle
from tracewell.llm import op09_embeddings as emb


def brute(ids, vectors, threshold=0.9):
    """id -> (n_links, component), for valid vectors."""
    u = emb.units(np.array(vectors, float))
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    root = np.arange(len(ids))
    order = np.argsort(ids)
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    root = emb._roots(len(ids), rank[a], rank[b])
    return {i: (int(hit[k].sum()), int(np.array(ids)[order][root[rank[k]]])) for k, i in enumerate(ids)}


def test_oracle(spark):
    assert oracle.check(spark, "/root/testdata/sf0.01", emb.op9_embeddings, emb.ORACLES["op9_embeddings"]) == 500


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    o = emb.units(rng.normal(size=(4000, 64)))
    q = emb.units(0.95 * o + 0.3 * emb.units(rng.normal(size=o.shape)))
    turn = emb.rotation(64)
    bits, f = emb.codes(o @ turn)
    small, step, lost = emb.rounded(q @ turn)
    assert np.allclose(np.linalg.norm(small * step[:, None] - q @ turn, axis=1), lost) and lost.max() < 0.02
    signs = np.unpackbits(bits, axis=1) * 2.0 - 1
    estimate = (signs * (q @ turn)).sum(1) / 8 / f
    assert abs((estimate - (o * q).sum(1)).mean()) < 0.005
    cos = o[:1500] @ q[:1500].T
    may = emb.candidates(bits[:1500], f[:1500], small[:1500], step[:1500], lost[:1500])
    assert not ((cos >= 0.9) & ~may).any() and may.mean() < 0.01


def test_oracle_with_links(spark, tmp_path):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    rng = np.random.default_rng(2)
    rows = t.to_pylist()
    for r in t.slice(0, 120).to_pylist():
        for k in (1, 2):
            v = np.array(r["embedding"]) * rng.uniform(0.3, 3)
            v = v + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * rng.choice([0, 0.3, 0.5, 1.0])
            rows.append(r | {"vec_id": r["vec_id"] + 100_000 * k, "embedding": v.tolist()})
    pq.write_table(t.from_pylist(rows, t.schema), f"{tmp_path}/embeddings.parquet")
    for name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        pq.write_table(t.slice(0, 1), f"{tmp_path}/{name}.parquet")
    assert oracle.check(spark, str(tmp_path), emb.op9_embeddings, emb.ORACLES["op9_embeddings"]) == len(rows)
    got = emb.op9_embeddings(spark, str(tmp_path)).collect()
    assert sum(r.n_links > 0 for r in got) > 200


@pytest.mark.parametrize("cell,block,exact", [(400, 2048, False), (20, 64, False), (20, 64, True)])
def test_groups_of_copies(spark, cell, block, exact):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x[:500] = x[0] + rng.normal(size=(500, 64)) * 0.2  # a hot group, a third of the rows
    for k in range(500, 700, 4):
        x[k:k + 4] = x[k] * rng.uniform(0.5, 2, (4, 1)) + rng.normal(size=(4, 64)) * np.linspace(0, 0.6, 4)[:, None]
    ids = rng.permutation(3000)[:1500]
    df = spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.dedup(df, cell=cell, block=block, exact=exact).collect()}
    expect = brute([int(i) for i in ids], x)
    wrong = [i for i in expect if got[i] != expect[i]]
    assert len(got) == 1500 and len(wrong) <= (6 if cell == 20 and not exact else 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (10, [-1.0, -2.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0]), (12, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.dedup(df).collect())
    assert got == [(i, 0, i, True) for i in range(1, 7)] + [(7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (10, 0, 10, True), (11, 0, 11, True), (12, 4, 7, False), (12, 4, 7, False)]
    assert emb.dedup(df.limit(0)).count() == 0 and emb.dedup(df.where("vec_id < 5")).count() == 4


def test_repeated_and_null_ids(spark):
    a, b, c = [1.0, 2.0, 0.0], [-1.0, 5.0, 0.0], [9.0, -2.0, 3.0]
    rows = [(None, a), (None, b), (3, a), (3, c), (5, b), (6, [0.0, 0.0, -2.0]), (None, [0.0, -0.0, -1.0]), (None, [-3.0, 0.5, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.dedup(df).collect()), key=str)
    expect = [(None, 1, 3, False), (None, 1, 5, False), (3, 1, 3, True), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 6, True), (None, 1, 6, False), (None, 0, None, False), (None, 0, None, False)]
    assert got == sorted(expect, key=str)


@pytest.mark.parametrize("cell", [400, 40])
def test_recall_with_cells(spark, cell, monkeypatch):
    """20,000 vectors, 5,000 pairs of them at a cosine of 0.90 to 0.93; cell=40 has several groups of centres."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(emb, "GROUP", 16)  # the driver builds the groups
    x = emb.units(rng.normal(size=(15_000, 64)) + 1.5 * rng.normal(size=(40, 64))[rng.integers(0, 40, 15_000)])
    cos = rng.uniform(0.90, 0.93, 5000)[:, None]
    away = rng.normal(size=(5000, 64))
    away = emb.units(away - (away * x[:5000]).sum(1, keepdims=True) * x[:5000])
    x = np.vstack([x, cos * x[:5000] + np.sqrt(1 - cos**2) * away])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    expect = brute(list(range(len(x))), x)
    got = {r.vec_id: r.n_links for r in emb.dedup(df, cell=cell).collect()}
    true, found = sum(n for n, _ in expect.values()), sum(got.values())
    assert true >= 9990 and all(got[i] <= expect[i][0] for i in expect)
    assert found >= 0.97 * true, found / true


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.7, 0.8])
def test_cells_of_vectors_with_a_common_direction(mean, monkeypatch):
    """500 centres in 62 groups, of which 32 are looked at; 5,000 pairs at a cosine of 0.90 to 0.93 among 20,000 vectors."""
    monkeypatch.setattr(emb, "GROUP", 8)
    rng = np.random.default_rng(14)
    x = emb.units((1 - mean) ** 0.5 * emb.units(rng.normal(size=(15_000, 64))) + mean**0.5 * emb.units(rng.normal(size=(1, 64))))
    cos = rng.uniform(0.90, 0.93, 5000)[:, None]
    away = rng.normal(size=(5000, 64))
    away = emb.units(away - (away * x[:5000]).sum(1, keepdims=True) * x[:5000])
    x = np.vstack([x, cos * x[:5000] + np.sqrt(1 - cos**2) * away])
    centres = emb.Centres(x[rng.choice(len(x), 500, replace=False)])
    near = centres.nearest(x)
    assert len(centres.tops) == 62 and np.bincount(np.concatenate(near)).max() < 0.05 * len(x)
    assert np.mean([bool(set(near[i]) & set(near[15_000 + i])) for i in range(5000)]) >= 0.95


def test_recall_with_a_common_direction(spark):
    """A mean cosine of 0.7, 5,000 pairs at 0.90 to 0.93."""
    rng = np.random.default_rng(15)
    x = emb.units(0.3**0.5 * emb.units(rng.normal(size=(8_000, 64))) + 0.7**0.5 * emb.units(rng.normal(size=(1, 64))))
    cos = rng.uniform(0.90, 0.93, 5000)[:, None]
    away = rng.normal(size=(5000, 64))
    away = emb.units(away - (away * x[:5000]).sum(1, keepdims=True) * x[:5000])
    x = np.vstack([x, cos * x[:5000] + np.sqrt(1 - cos**2) * away])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    expect = brute(list(range(len(x))), x)
    got = {r.vec_id: r.n_links for r in emb.dedup(df, cell=40).collect()}
    true, found = sum(n for n, _ in expect.values()), sum(got.values())
    assert true >= 9990 and all(got[i] <= expect[i][0] for i in expect)
    assert found >= 0.95 * true, found / true

import collections
import random

import pyarrow.parquet as pq
import pytest

from tests.llm import oracle
from tracewell.llm import op10_minhash as mh


def brute(docs, percent=80, n=5):
    """docs: (id, text) -> {id: (n_shingles, component)} by an inverted index over all shingles."""
    sets, inverted = {}, collections.defaultdict(list)
    for d, t in docs:
        w = tuple((t or "").encode().lower().split())
        sets[d] = {w[i:i + n] for i in range(len(w) - n + 1)} or ({w} if w else set())
        for s in sets[d]:
            inverted[s].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = collections.Counter(o for x in s for o in inverted[x] if o < d)
        for o, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(rows, docs, percent=80, n=5):
    expect = brute(docs, percent, n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(docs)
    assert got == expect
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_documents(spark, sf):
    d = f"/root/testdata/sf{sf}"
    t = pq.read_table(f"{d}/documents.parquet").to_pydict()
    check(mh.op10_minhash(spark, d).collect(), list(zip(t["doc_id"], t["text"], strict=True)), 85, 3)


def test_oracle(spark):
    assert oracle.check(spark, "/root/testdata/sf0.01", mh.op10_minhash, mh.ORACLES["op10_minhash"]) == 1000


def test_star_of_copies_whose_copies_are_not_linked(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    docs = [(5000, " ".join(base))]
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(400)]
    docs += [(6000 + i, " ".join(chain[12 * i:12 * i + 200])) for i in range(16)]
    check(mh.dedup(spark.createDataFrame(docs, "doc_id long, text string"), percent=85, n=3).collect(), docs, 85, 3)


def test_dense_groups_joined_by_one_link(spark):
    rng = random.Random(7)
    docs, groups = [], 5
    for page in range(groups):
        base = [f"p{page}w{i}" for i in range(300)]
        for g, revision in enumerate((base, base[:140] + [f"p{page}v{i}" for i in range(20)] + base[160:])):
            for i in range(60):
                w = list(revision)
                # the first copies of both share their edits, the others' differ: only the first two link
                for at in (21, 251) if i == 0 else rng.sample([*range(5, 130, 5), *range(170, 295, 5)], 1):
                    w[at] = f"p{page}s{at}" if i == 0 else f"x{rng.randint(0, 10**9)}"
                docs.append((1000 * page + 100 * g + i, " ".join(w)))
    assert len({c for _, c in brute(docs, 85, 3).values()}) == groups
    assert len({c for _, c in brute([x for x in docs if x[0] % 1000 != 100], 85, 3).values()}) == 2 * groups
    check(mh.dedup(spark.createDataFrame(docs, "doc_id long, text string"), percent=85, n=3).collect(), docs, 85, 3)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "É é"), (9, "é É"), (10, "a b c"), (11, "a b c a b c"), (12, "c " * 30000), (13, "x c c c")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, rep int")
    check(mh.dedup(df, percent=85, n=3).collect(), docs, 85, 3)
    twice = mh.dedup(df.where("doc_id = 4").unionByName(df.where("doc_id = 4"))).collect()
    assert [(r.component_id, r.kept) for r in twice] == [(4, True)] * 2
    assert mh.dedup(df.limit(0)).count() == 0 and mh.survivors(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(words[a:b])
    docs = [(1, text(0, 60)), (2, text(1, 60)), (7, text(0, 15)), (7, text(1, 15)), (7, "b c d e f g"), (None, "x y z x y z"), (None, "p q r s t u"), (None, "x y z x y z"), (None, text(0, 59)), (9, ""), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, cid int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in mh.dedup(df).collect()), key=str)
    # the two parts under id 7 have 10 of 11 shingles in common, the rest of that id's rows nothing
    expect = [(1, 1, True), (2, 1, False), (7, 7, True), (7, 7, True), (7, 7, True), (None, None, False), (None, None, False), (None, None, False), (None, 1, False), (9, 9, True), (9, 9, True), (9, 9, True)]
    assert got == sorted(expect, key=str)
    left = mh.survivors(df).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left if r.doc_id != 7) == sorted(str(x) for x in [(1, text(0, 60)), (None, "x y z x y z"), (None, "p q r s t u"), (9, ""), (9, None), (9, "")])
    assert sorted(r.text for r in left if r.doc_id == 7) in (sorted(["b c d e f g", text(0, 15)]), sorted(["b c d e f g", text(1, 15)]))
    assert mh.survivors(df.unionByName(df)).count() == len(left) + 3  # rows without words all stay


def test_small_regions_and_many_partitions(spark):
    rng = random.Random(11)
    shared = [f"t{i}" for i in range(300)]
    docs = []
    for i in range(700):  # pages of one template: too many for a region at every depth; every fourth has a closer copy
        docs.append((2 * i, " ".join(shared + [f"u{i}x{k}" for k in range(40)])))
        if i % 4 == 0:
            docs.append((2 * i + 1, docs[-1][1].replace(f"u{i}x7", "y")))
    docs += [(5000 + i, " ".join(shared[:40])) for i in range(200)]
    rng.shuffle(docs)
    expect = brute(docs)
    out = []
    for parts in (3, 50):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = mh.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), run=16).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        out.append({r.doc_id: r.component_id for r in rows})
    assert out[0] == out[1]
    wrong = [d for d in expect if out[0][d] != expect[d][1]]
    assert not wrong, len(wrong)


def test_recall_among_pages_of_one_template(spark):
    """Many pages below the threshold for all others, some pairs above: the search has to find the pairs."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(100)]
    docs = []
    for i in range(1500):
        own = [f"a{rng.randint(0, 10**9)}" for _ in range(60)]
        docs.append((2 * i, " ".join(template + own)))
        if i % 2:
            own[30] = "z"
            docs.append((2 * i + 1, " ".join(template + own)))
    expect = brute(docs)
    got = {r.doc_id: r.component_id for r in mh.dedup(spark.createDataFrame(docs, "doc_id long, text string"), run=64).collect()}
    pairs = [d for d in expect if d % 2]
    assert all(expect[d][1] == d - 1 for d in pairs)
    assert sum(got[d] == d - 1 for d in pairs) >= 0.99 * len(pairs) and all(got[d] == d for d in expect if not d % 2)


@pytest.mark.parametrize("others", [0, 6, 60])
def test_components_of_a_hot_prefix_meet(spark, others):
    """more documents than a region holds share all minima; any two of different components are compared somewhere."""
    n, run = 150, 16
    minima = bytes(4 * mh.TREES * mh.DEPTH)
    rows = [(i, minima, 0, 0, 100 + i if i < others else 7) for i in range(n)]
    dealt = mh.forest(spark.createDataFrame(rows, "cid long, minima binary, low0 long, low1 long, component long"), run).collect()
    regions, component = collections.defaultdict(set), {r[0]: r[4] for r in rows}
    for r in dealt:
        regions[r.region].add(r.cid)
    met = {(a, b) for x in regions.values() for a in x for b in x if component[a] < component[b]}
    assert met == {(a, b) for a in range(n) for b in range(n) if component[a] < component[b]}
    assert max(map(len, regions.values()), default=0) <= 3 * run
    assert len(dealt) <= mh.TREES * 2 * n * -(-2 * max(others, 1) // run)


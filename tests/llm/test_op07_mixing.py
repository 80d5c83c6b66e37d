import collections
import math

import pyarrow.parquet as pq
import pytest

from tracewell.llm import op07_mixing as mixing


def brute_exponent(tokens, entropy=None, most_repeats=None):
    total = sum(tokens)
    p = [x / total for x in tokens if x]

    def fits(t):
        w = [x**t for x in p]
        z = sum(w)
        q = [x / z for x in w]
        r = [a / b for a, b in zip(q, p, strict=True)]
        return (entropy is None or -sum(x * math.log(x) for x in q) <= entropy + 1e-12) and (most_repeats is None or max(r) / min(r) <= most_repeats + 1e-12)

    if fits(0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


@pytest.mark.parametrize("target", [{"entropy": 1.0, "most_repeats": None}, {"most_repeats": 2.5}, {"most_repeats": 1e9}, {"entropy": 0.1, "most_repeats": 1.0}])
def test_exponent(spark, target):
    tokens = [1000, 10, 300, 0, 45]
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(tokens)], "_source string, n_tokens long")
    assert abs(mixing.exponent(mixing.shares(df), **target) - brute_exponent(tokens, **target)) < 1e-8


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/documents.parquet").to_pydict()
    n = {i: len((x or "").encode().split()) for i, x in zip(t["doc_id"], t["text"], strict=True)}
    src = dict(zip(t["doc_id"], t["source"], strict=True))
    tokens = collections.Counter()
    for i in n:
        tokens[src[i]] += n[i]
    e = brute_exponent(list(tokens.values()), most_repeats=mixing.MOST_REPEATS)
    weight = {s: (x / sum(tokens.values()))**e for s, x in tokens.items()}
    z = sum(weight.values())
    budget = z * max(tokens[s] / weight[s] for s in tokens)
    rows = mixing.op7_mixing(spark, d).collect()
    assert all(r.n_tokens == n[r.doc_id] and r.source == src[r.doc_id] for r in rows)
    got, times = collections.Counter(), collections.Counter(r.doc_id for r in rows)
    for r in rows:
        got[r.source] += r.n_tokens
    assert set(times) == set(n)  # every source is read whole at least once
    for s in tokens:
        wanted = weight[s] / z * budget
        assert wanted - max(n[i] for i in n if src[i] == s) - 1 <= got[s] <= wanted + 1
        own = [times[i] for i in n if src[i] == s]
        assert max(own) - min(own) <= 1 and max(own) <= math.ceil(mixing.MOST_REPEATS)


def check_order(rows, docs, block_docs):
    """docs: (key, source); rows of a mix. Each epoch of a source orders its blocks anew, and the broken one takes the first."""
    size = collections.Counter(s for _, s in docs)
    of_block, orders = {}, collections.defaultdict(dict)
    for r in rows:
        assert of_block.setdefault((r.doc_id, r.source), r.block) == r.block and 0 <= r.block < max(1, math.ceil(size[r.source] / block_docs))
        assert orders[r.source, r.epoch].setdefault(r.block, r.rank) == r.rank
    last = {s: max(e for x, e in orders if x == s) for s, _ in orders}
    for (s, e), order in orders.items():
        assert sorted(order.values()) == list(range(len(order)))
        whole = collections.Counter(r.doc_id for r in rows if r.source == s and r.epoch == e)
        if e < last[s]:
            assert sum(whole.values()) == size[s] and set(order) == {b for (_, x), b in of_block.items() if x == s}
    for s in last:
        many = [tuple(sorted(orders[s, e], key=orders[s, e].get)) for e in range(last[s])]
        assert len(set(many)) == len(many) or not many or len(many[0]) < 5
        cut = [r for r in rows if r.source == s and r.epoch == last[s]]
        for b, rank in orders[s, last[s]].items():  # all of every block but the last
            if rank < max(r.rank for r in cut):
                assert {r.doc_id for r in cut if r.block == b} == {d for (d, x), y in of_block.items() if x == s and y == b}


def test_blocks_are_ordered_anew_in_each_epoch(spark, monkeypatch):
    docs = [(i, "big") for i in range(1500)] + [(5000 + i, "small") for i in range(260)] + [(9000 + i, None) for i in range(40)]
    df = spark.createDataFrame([(i, s, "w " * (1 + i % 5)) for i, s in docs], "doc_id long, source string, text string")
    rows = mixing.mix(df, block_docs=16).collect()
    check_order(rows, docs, 16)
    assert max(r.epoch for r in rows) >= 1
    key = lambda r: tuple(map(str, r))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)  # the way of many sources
    assert sorted(mixing.mix(df, block_docs=16).collect(), key=key) == sorted(rows, key=key)


def test_ranks_against_one_sort(spark):
    rows = [(s, e, b, b * 7 % 11) for s in ("a", None) for e in range(3) for b in range(90)]
    got = mixing.ranked(spark.createDataFrame(rows, "_source string, epoch int, block int, tokens long")).collect()
    for s in ("a", None):
        for e in range(3):
            own = sorted((r for r in got if r["_source"] == s and r.epoch == e), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(90)) and [r.before for r in own] == [sum(x.tokens for x in own[:k]) for k in range(90)]


@pytest.mark.parametrize("budget", [0, 100, 5000])
def test_budgets_hot_source_nulls_and_clashes(spark, budget):
    rows = [(i, "hot" if i % 3 else None, "w " * (i % 7), 5) for i in range(600)] + [(9999, "empty", None, 5), (1, "hot", "w w", 5), (1, "hot", "w w", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, Block int")
    out = mixing.mix(df, budget=budget, block_docs=16).collect()
    got = collections.Counter()
    for r in out:
        got[r.source] += r.n_tokens
    tokens = collections.Counter()
    for _, s, x, _ in rows:
        tokens[s] += len((x or "").split())
    e = brute_exponent([x for x in tokens.values()], most_repeats=mixing.MOST_REPEATS)
    weight = {s: (x / sum(tokens.values()))**e if x else 0 for s, x in tokens.items()}
    for s in tokens:
        wanted = weight[s] / sum(weight.values()) * budget
        assert wanted - 7 <= got[s] <= wanted + 1
    again = mixing.mix(df.repartition(3), budget=budget, block_docs=16).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(out, key=key) == sorted(again, key=key)
    assert mixing.mix(df.limit(0)).count() == 0

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.oracle import check
from tracewell.llm import op12_divergence as div

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, top):
    """rows: (text, lang, source) -> the result's rows, in plain integers."""
    docs = [([w.translate(LOWER) for w in TERM.findall(t or "")], lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(w, s) for w, x, s in docs if x == lang]
        df = Counter(t for w, _ in own for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for w, s in own:
            counts[s].update(t for t in w if t in kept)
        every = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("seed,sizes", [(0, {}), (1, {"flush_bytes": 400, "block_entries": 25}), (2, {"block_entries": 7})])
def test_random_documents(spark, seed, sizes):
    rng = random.Random(seed)
    words = ["the", "The", "über", "ÜBER", "a", "b1c", "x_y", "naïve", "zz", "日本", "q" * 40] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["de", "en", "en"]), rng.choice(["web", "web", "web", "a", "b", "ö", "z"])) for _ in range(250)]
    rows += [(None, "en", "web"), ("", None, None), ("the", None, None), ("the " * 50_000, "en", "long"), ("12 34", "en", "no-terms"), ("a", "xx", "s"), (None, "xx", "t"), ("a", "yy", "only")]
    rows += [rows[3]] * 5
    df = spark.createDataFrame([(1, *r, 0) for r in rows], "doc_id long, text string, lang string, source string, N int").repartition(4)
    got = div.audit(df, least=6, top=4, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 6, 4)


def test_no_documents(spark):
    assert div.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_equal_hashes_are_told_apart():
    texts = ["one two three one two one", None, "tows two ÖL"]
    batch = pa.record_batch({"lang": ["x"] * 3, "source": ["s"] * 3, "text": texts})
    for digest in (None, lambda b: 7, len):
        got = {(r["term"].decode(), r["n"], r["docs"]) for r in div.counted(batch, digest).to_pylist()}
        assert got == {("one", 3, 1), ("two", 3, 2), ("three", 1, 1), ("tows", 1, 1), ("Öl", 1, 1)}


def test_shares_of_large_counts():
    count, total = np.array([0, 3, 8 * 10**15]), np.array([8 * 10**15] * 3)
    assert div.share(count, total, 5).tolist() == [1 + 10**9 * (int(c) + 2) // (8 * 10**15 + 10) for c in count]
    assert div.share(np.array([4]), np.array([4]), 1).tolist() == [10**9 + 1]


def test_query(spark):
    assert check(spark, "/root/testdata/sf0.01", div.op12_divergence, div.ORACLE) > 0

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.oracle import check
from tracewell.llm import op13_phrases as ph

LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := [x for x in re.split(r"[\x20\x09]+", p) if x])]


def brute(rows, least, top):
    """rows: (text, lang) -> the result's rows, from a count of every phrase."""
    out = []
    for lang in {x or "und" for _, x in rows}:
        f, n = Counter(), 0
        for t, x in rows:
            if (x or "und") == lang:
                for w in pieces(t):
                    n += len(w)
                    f.update(tuple(w[i:i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            inside = any(len(o) > len(p) and 100 * b >= 100 * a and any(o[i:i + len(p)] == p for i in range(len(o))) for o, b in long.items())
            if not inside:
                score, _, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,sizes", [(0, {}), (1, {"flush_bytes": 300, "bucket_phrases": 4000}), (2, {"filter_bits": 1 << 15, "flush_bytes": 2000})])
def test_random_texts(spark, seed, sizes):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ü", "Ü", "x\x85y", "a\xa0b", "a", "b", "c"] + [f"r{i}" for i in range(60)]
    common = ["new york city hall", "as well as the", "of the a b c", "NEW york"]
    rows = []
    for _ in range(220):
        parts = [rng.choice(common) if rng.random() < 0.4 else rng.choices(words, weights=[9] * 10 + [1] * 60)[0] for _ in range(rng.randint(0, 12))]
        rows.append(("".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0c"]) for p in parts), rng.choice(["en", "en", None, "de"])))
    rows += [(None, "en"), ("", None), (" .,", "xx"), ("the of " * 40_000, "en"), ("a" * 100_000, "en"), ("new york city hall", "en")] + [("same piece here.", "und")] * 30
    df = spark.createDataFrame([(r[0], r[1], 0, "x") for r in rows], "text string, lang string, N int, piece string").repartition(3)
    got = ph.mine(df, least=12, top=15, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 12, 15)


def test_no_documents(spark):
    df = spark.createDataFrame([(None, "en")], "text string, lang string")
    assert ph.mine(df).count() == 0 and ph.mine(df.limit(0)).count() == 0


def test_pieces_of_bytes():
    texts = ["One,two  THREE\t.x", None, "", "a\n\nb ", "é!é"]
    own, text, n = ph.pieces_of(pa.array(texts))
    assert own.to_pylist() == ["one ", "two three ", "x ", "a ", "b ", "é ", "é "]
    assert text.tolist() == [0, 0, 0, 3, 3, 4, 4] and n.tolist() == [1, 2, 1, 1, 1, 1, 1]


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("x", 1, "a", 9 * 10**15), ("x", 1, "b", 8 * 10**15), ("x", 2, "a b", 7 * 10**15)], "lang string, m int, phrase string, a long")
    totals = spark.createDataFrame([("x", 5 * 10**17)], "lang string, n long")
    assert ph.scored(counts, totals).first().score == 1000 * 7 * 10**15 * 5 * 10**17 // (9 * 10**15 * 8 * 10**15)


def test_query(spark):
    assert check(spark, "/root/testdata/sf0.01", ph.op13_phrases, ph.ORACLE) > 0

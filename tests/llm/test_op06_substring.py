import hashlib
import random

import pyarrow.parquet as pq
import pytest

from tracewell.llm import op06_substring as sub


def brute(docs, window=13):
    """docs: (id, text) -> n_words, n_removed, kept text of each, by a table of every window's smallest id."""
    words = [(d if d is not None else sub.LAST_ID, (t or "").encode().split()) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((len(w), sum(gone), kept))
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_documents(spark, sf):
    d = f"/root/testdata/sf{sf}"
    t = pq.read_table(f"{d}/documents.parquet").to_pydict()
    rows = {r.doc_id: r for r in sub.op6_substring(spark, d).collect()}
    expect = brute(list(zip(t["doc_id"], t["text"], strict=True)))
    assert len(rows) == len(expect)
    assert sum(e[1] for e in expect) > 0
    for i, (n, gone, kept) in zip(t["doc_id"], expect, strict=True):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats_over_many_chunks(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefg") for _ in range(rng.randint(11, 40))] for _ in range(6)]
    docs = []
    for i in range(300):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages)[rng.randint(0, 4):] if rng.random() < 0.4 else [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 30))]
        docs.append((rng.randint(0, 250), rng.choice([" ", "\n", "\t\x0b"]).join(w)))
    docs += [(7, None), (None, " ".join(passages[0] * 3)), (8, ""), (9, "  \n"), (10, "a\x85b c d e f g h i j k l m n"), (5, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, N_words int")
    out = sub.dedup(df, chunk_bytes=1500, bucket_hashes=700).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, out), key=key) == sorted([(d, *e) for (d, _), e in zip(docs, brute(docs), strict=True)], key=key)


def test_empty_and_spans(spark):
    df = spark.createDataFrame([(1, "x " * 40), (2, "y " + "x " * 13 + "z")], "doc_id long, text string")
    assert sub.dedup(df.limit(0)).count() == 0
    out = {r.doc_id: r for r in sub.dedup(df).collect()}
    assert out[1].n_removed == 0 and out[2].kept_text == "y z" and [tuple(s) for s in out[2].removed_spans] == [(1, 14)]

import re

import pyarrow.parquet as pq

from tracewell.llm import op05_licenses as lic

PHRASES = [(label, p.split()) for label, p in lic.PHRASES]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(lic.WORD, low)
    at = sorted((i, label) for label, p in PHRASES for i in range(len(w)) if w[i:i + len(p)] == p)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def brute_notices(text, k=lic.K):
    """(first_word, last_word, template, label, coverage) of notices: hits by diagonal, merged, walked in order."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(lic.WORD, low)
    out = []
    for n, (label, notice) in enumerate(lic.NOTICES):
        t = notice.split()
        grams = len(t) - k + 1
        at_of = {}
        for q in range(grams):
            at_of.setdefault(tuple(t[q:q + k]), []).append(q)
        hits = sorted((p - q, p, q) for p in range(len(w) - k + 1) for q in at_of.get(tuple(w[p:p + k]), ()))
        groups = []
        for h in hits:
            if not groups or h[0] - groups[-1][-1][0] > lic.APART:
                groups.append([])
            groups[-1].append(h)
        for g in groups:
            pos, at, first, many = -1, -1, None, 0
            for p, q in sorted((p, q) for _, p, q in g):
                if p > pos and q > at:
                    pos, at, many, first = p, q, many + 1, p if first is None else first
            if many / grams >= lic.COVERAGE and pos + k - first <= lic.STRETCH * len(t):
                out.append((first, pos + k - 1, n + len(lic.PHRASES), label, many / grams))
    return sorted(out)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/documents.parquet").to_pydict()
    rows = {r.doc_id: r for r in lic.op5_licenses(spark, d).collect()}
    assert len(rows) == len(t["doc_id"])
    for i, text in zip(t["doc_id"], t["text"], strict=True):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        notices = brute_notices(text)
        assert r.labels == ",".join(sorted({*filter(None, r.base_labels.split(",")), *[n[3] for n in notices]})) and r.n_spans == r.n_base + len(notices)
        assert abs(r.score - max([1.0] * (r.n_base > 0) + [n[4] for n in notices], default=0.0)) < 1e-12
    assert sum(r.n_base for r in rows.values()) > 3


def test_edges(spark):
    texts = [None, "", "a b", "CC-BY-NC", "cc by nc cc by nc", "Under the MIT License, under the mit\nlicense", "İunder the mit license", "apache license version 20",
             "this work is licensed under the brand new gnu general public license version 3", "Permission is granted free of charge to any person obtaining a copy of this software and associated documentation files", "x " * 30000 + "cc by nc"]
    df = spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, template int")
    out = lic.digests(df).collect()
    key = lambda r: (r[0], r[1])
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out], key=key) == sorted([(i % 9, *brute(t)) for i, t in enumerate(texts)], key=key)
    labels = {(r.doc_id, r.n_words): (r.labels, r.score) for r in out}
    assert labels[8, 14][0] == "gpl-3" and labels[0, 19][0] == "mit" and labels[4, 6] == ("cc-by-nc", 1.0)
    assert lic.digests(df.limit(0)).count() == 0


def test_repeated_rows_keep_their_own_results(spark):
    df = spark.createDataFrame([(1, "cc by nc")] * 3, "doc_id long, text string")
    assert [r.n_base for r in lic.digests(df).collect()] == [1, 1, 1]


def test_spans_are_verified(spark):
    notice = lic.NOTICES[0][1]
    w = notice.split()
    texts = [notice, "a b " + notice + " c", " ".join(w[:9] + ["odd"] + w[9:]), " ".join(w[:4] + w[6:]), " ".join(w[10:] + w[:10]), " ".join(w[i] for i in range(len(w) - 1, -1, -1)), (notice + " ") * 3, " ".join(f"{x} pad pad" for x in w)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: sorted((s.first_word, s.last_word, s.template, s.label, s.coverage) for s in r.spans if not s.exact) for r in lic.scan(df, ["doc_id"]).collect()}
    assert got == {i: brute_notices(t) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(8)] == [1, 1, 1, 1, 0, 0, 3, 0] and got[1][0][:2] == (2, len(w) + 1) and got[3][0][:2] == (0, len(w) - 3)


def test_a_long_text_of_hits(spark):
    """Linear in the text: forty thousand places of a phrase in one text."""
    df = spark.createDataFrame([(1, "cc by nc " * 40_000 + "x " * 480_000)], "doc_id long, text string")
    r = lic.digests(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (600_000, 40_000, 0, 119_997)

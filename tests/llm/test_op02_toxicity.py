import zlib

import numpy as np
import pyarrow.parquet as pq

from tracewell.llm import op02_toxicity as tox


def naive(net, text):
    """The network's logit, position by position; a text without words is one padding."""
    words = tox.words_of(text)
    vec = [net.table[list(tox.feature_ids(w))].sum(0) for w in words] + [np.zeros(tox.DIM, np.float32)] * 3
    hidden, col = [], 0
    for w in tox.WIDTHS:
        cols = [slice(col + k * tox.FILTERS, col + (k + 1) * tox.FILTERS) for k in range(w)]
        hidden.append(np.max([sum(vec[i + k] @ net.filters[:, c] for k, c in enumerate(cols)) for i in range(max(len(words), 1))], 0))
        col += w * tox.FILTERS
    return float(np.maximum(np.concatenate(hidden) + net.bias, 0) @ net.out + net.shift[0])


def test_scorer_against_position_by_position():
    net = tox.Network(3)
    for text in ("", "one", "one two", "the one two three four", "x " * 50 + "y"):
        assert abs(tox.Scorer(net).raw([text])[0][0] - naive(net, text)) < 1e-3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tox.op2_toxicity(spark, d).collect()}
    t = pq.read_table(f"{d}/documents.parquet").to_pydict()
    assert len(rows) == len(t["doc_id"])
    labels = pq.read_table(f"{d}/labels.parquet").to_pydict()
    held = [(rows[i], y) for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r, _ in held)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert np.mean([r.predicted for r, y in held if y]) > 0.75


def test_more_distinct_words_than_remembered(monkeypatch):
    net = tox.Network(3)
    text = " ".join(f"w{i}" for i in range(300)) + " the"
    whole, language = (x[0] for x in tox.Scorer(net).raw([text]))
    monkeypatch.setattr(tox, "MEMO_WORDS", 64)
    raw, found = tox.Scorer(net).raw(["a b", text, "c d"])
    assert abs(raw[1] - whole) < 1e-3 and found.tolist() == [len(tox.LANGUAGES), language, len(tox.LANGUAGES)] and language == tox.LANGUAGES.index("en")


def test_query_rows_against_position_by_position(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = tox.fit(tox._labelled.labelled_texts(docs, labels, "toxic", tox.SAMPLE))
    rows = {r.doc_id: r for r in tox.op2_toxicity(spark, sf_dir).collect()}
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    for i, text in list(zip(t["doc_id"], t["text"], strict=True))[:80]:
        words = tox.words_of(text)
        count = [sum(w in tox.FUNCTION_WORDS[x].split() for w in words) for x in tox.LANGUAGES]
        language = count.index(max(count)) if any(count) else len(count)
        logit = naive(net, text) - net.thresholds[language] + np.log(0.7 / 0.3)
        assert abs(rows[i].score - 1 / (1 + np.exp(-logit))) < 1e-3 and rows[i].predicted == (rows[i].score >= 0.7)
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_nulls_repeats_clashes_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "c"), (None, "y", "d")], "doc_id long, text string, Toxicity string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    out = tox.digests(docs, labels).collect()
    assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out)
    scored = tox.score(docs, tox.Network(1)).collect()
    assert scored[0].toxicity == scored[1].toxicity and scored[2] == scored[3]
    assert tox.digests(docs.limit(0), labels.limit(0)).count() == 0

import zlib

import numpy as np
import pyarrow.parquet as pq

from tracewell.llm import op04_quality as q


def test_features_against_plain_counts():
    text = "The CAT*** the the the|\nok 12! WORD!!\nok 12! WORD!!"
    f = q.features(text)
    w = text.split()
    more = f[len(q._KINDS):]
    assert np.isclose(more[0], sum(a == b for a, b in zip(w, w[1:])) / len(w)) and np.isclose(more[1], len(set(w)) / len(w))
    assert np.isclose(more[3], sum(x[-1] in "!?|#$%&*@^~=+_<>" for x in w) / len(w))
    assert np.isclose(more[4], sum(x.upper() == x and x.lower() != x for x in w) / len(w))
    assert np.isclose(more[5], 1 - len(set(text.split("\n"))) / 3)
    assert np.isclose(f[q._KINDS.index("newline")] ** 2, 2 / len(text))
    assert not q.features("").any() and not q.features(None).any() and np.isfinite(q.features(" \n")).all()


def test_non_negative_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(0)
    z, kind, prior = rng.normal(size=40), np.repeat([1, 0], 20), 0.3

    def risk(z):
        neg = np.logaddexp(0, z)[kind == 0].mean() - prior * np.logaddexp(0, z)[kind == 1].mean()
        return prior * np.logaddexp(0, -z)[kind == 1].mean() + neg

    g = q.nn_pu_slopes(prior)(z, kind)
    for i in (0, 5, 25, 39):
        d = np.zeros(40)
        d[i] = 1e-5
        assert abs((risk(z + d) - risk(z - d)) / 2e-5 - g[i]) < 1e-6


def test_class_prior():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    u = np.r_[p[2000:2000 + 600], n[:400]]
    cuts = q.prior_cuts(p[:2000])
    assert abs(q.class_prior(p[:2000], cuts, (u[:, None] >= cuts).sum(0), len(u)) - 0.6) < 0.06


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in q.op4_quality(spark, d).collect()}
    t = pq.read_table(f"{d}/labels.parquet").to_pydict()
    held = [(rows[i], y) for i, y in zip(t["doc_id"], t["quality"], strict=True) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(rows) == pq.read_metadata(f"{d}/documents.parquet").num_rows
    assert np.mean([r.predicted == y for r, y in held]) > 0.98 and np.mean([r.predicted for r, y in held if y]) > 0.99


def test_nulls_repeats_clashes_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "c"), (None, "y", "d")], "doc_id long, text string, Quality string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in q.digests(docs, labels).collect()] == [1.0] * 5
    assert q.digests(docs.limit(0), labels.limit(0)).count() == 0
    x = lambda texts: np.array([q.features(t) for t in texts])
    out = q.score(docs, q.fit(x(["good text here."] * 9), x(["good text here."] * 5 + ["BAD!! BAD!!"] * 4))).collect()
    assert out[0].quality == out[1].quality and out[2] == out[3]


def test_query_rows_against_plain_numpy(spark, sf_dir):
    """The same network from plain lists: samples by the same rule, the prior from every unlabelled text."""
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    marked = dict(zip(labels["doc_id"], labels["quality"], strict=True))
    x = {i: q.features(text).astype("<f4").astype(float) for i, text in zip(t["doc_id"], t["text"], strict=True)}
    assert len(x) < q.UNLABELLED  # every row is in the samples
    good = [x[i] for i in sorted(x) if marked.get(i) == 1 and zlib.crc32(str(i).encode()) % 3 != 1]
    free = [x[i] for i in sorted(x) if i not in marked] or [x[i] for i in sorted(x)]
    net = q.fit(np.array(good), np.array(free))
    for r in q.op4_quality(spark, sf_dir).collect():
        assert abs(r.score - net.scores(x[r.doc_id][None])[0]) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_a_text_of_megabytes(spark):
    text = "Plain words of a sentence, again. " * 100_000
    df = spark.createDataFrame([(1, text), (2, "Plain words of a sentence, again. ")], "doc_id long, text string")
    a, b = (np.frombuffer(r.features, "<f4") for r in q.described(df).orderBy("doc_id").collect())
    assert np.allclose(a[:len(q._KINDS)], b[:len(q._KINDS)], atol=1e-2)

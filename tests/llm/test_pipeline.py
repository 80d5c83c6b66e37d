import collections
import hashlib

import numpy as np

import corpus_pipeline as cp
from tests.llm.test_op01_bpe import PATH
from tests.llm.test_op06_substring import brute as brute_substring
from tests.llm.test_op10_minhash import brute as brute_minhash
from tracewell.llm import op04_quality, op07_mixing


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        out = cp._shared.materialise(stage(spark, docs, d), "test")
        seen.append((docs, out))
        if name != cp.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and dict(out.dtypes) == dict(docs.dtypes)
        docs = out
    rows = [({r.doc_id: r for r in a.collect()}, b.collect()) for a, b in seen]

    before, after = rows[0]
    described = op04_quality.described(seen[0][0].select("doc_id", "text"))
    net = op04_quality.learned(described, spark.read.parquet(f"{d}/labels.parquet"))
    ids = list(before)
    x = np.array([op04_quality.features(before[i].text).astype("<f4") for i in ids], float)
    good = {i for i, s in zip(ids, net.scores(x), strict=True) if s >= 0.5}
    assert {r.doc_id for r in after} == good and all(r == before[r.doc_id] for r in after)

    before, after = rows[1]
    groups = brute_minhash([(i, r.text) for i, r in before.items()], 80, 5)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in groups.items() if c == i)

    before, after = rows[2]
    expect = dict(zip(before, brute_substring([(i, r.text) for i, r in before.items()]), strict=True))
    assert len(after) == len(before)
    for r in after:
        n, gone, kept = expect[r.doc_id]
        old = before[r.doc_id].text
        assert (r.text.encode().split() == kept.encode().split() and r.text.count("\n") <= old.count("\n") if gone else r.text == old) and r.n_chars == len(r.text)

    before, after = rows[3]
    times = collections.Counter(r.doc_id for r in after)
    assert set(times) == set(before) and max(times.values()) <= op07_mixing.MOST_REPEATS + 1 and all(r == before[r.doc_id] for r in after)

    before, after = rows[4]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    assert len(after) == len(rows[3][1])
    for r in after:
        ids = library.encode(before[r.doc_id].text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r.token_ids) == packed and r.ids_sha256 == hashlib.sha256(packed).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest()


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    assert cp.run(spark, sf_dir).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(1, words), (1, words), (1, ["other", "words"]), (2, words[1:]), (None, words[2:]), (None, ["alone"]), (3, [])]
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 5) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.minhash_near_dedup(spark, df, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("1", " ".join(words)), ("1", "other words"), ("None", "alone"), ("3", "")])


def test_cut_texts_keep_their_lines(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"{passage}\nfirst end"), (2, f"head\n\n  {passage}\ttail\nlast  line "), (3, f"x\n{passage}\n")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in cp.substring_dedup(spark, df, "").collect()} == {1: rows[0][1], 2: "head\n\n  tail\nlast  line ", 3: "x\n"}


#: Every name that a stage or its operators use for a column of their own.
WORKING = "features quality score chunk kept_text n_words n_removed removed_spans whole blocks room left tokens docs share before block rank epoch place n_tokens _source _hash _key _take _takes _s _b _id _rows _first _row set_key first least cid hash id component n_shingles carried none bucket".split()


def test_columns_of_any_name_and_odd_rows(spark, sf_dir):
    words = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[1:])), (None, " ".join(words[5:60] + ["x"] * 60)), (None, None), (4, ""), (5, "tail " * 250_000), (6, None), (7, "Quiet words stand here, and others follow them. " * 3)]
    extra = [c for c in WORKING if c not in ("text", "source", "lang", "doc_id", "n_chars")]
    df = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, *[f"{c}-{k}" for c in extra]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    docs = df
    for name, stage in cp.STAGES[:-1]:
        out = cp._shared.materialise(stage(spark, docs, sf_dir), "test")
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        for r in out.collect():
            k = r["chunk"].partition("-")[2]
            assert all(r[c] == f"{c}-{k}" for c in extra)
            assert name == "substring dedup" or r.text == rows[int(k)][1] or name == "mixing sources"
        docs = out if name != "quality classifier" else df  # the classifier may reject these few
    assert cp.bpe_encoding(spark, docs, sf_dir).count() == docs.count() > 0

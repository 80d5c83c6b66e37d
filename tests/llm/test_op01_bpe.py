import hashlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import op01_bpe as bpe

PATH = bpe.tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "a", "   \n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "é" * 300, "!" * 5000, "aaaaaaaaaaaaaaaaaaaaaaaa", "it's we'll 12345  \x85\xa0\x1c x", "\U0001f600́ 日本語"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(text):
    import numpy as np

    return np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    expect = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == expect
    assert bpe.codec(PATH).decode(expect) == library.decode(expect, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=80))
def test_any_text(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, sf_dir, library):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    assert len(rows) == len(t["doc_id"])
    for d, text in zip(t["doc_id"], t["text"], strict=True):
        e = library.encode(text or "", add_special_tokens=False).ids
        assert rows[d].n_tokens == len(e)
        assert rows[d].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "hi", None), (2, "hi", None)], "doc_id long, text string, `Token_ids` string")
    out = bpe.decode(bpe.encode(df, "byte_bpe_50k.json"), "byte_bpe_50k.json").collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_text) for r in out) == [(1, 0, ""), (2, 0, ""), (2, 1, "hi"), (2, 1, "hi")]
    assert bpe.digests(df.limit(0)).count() == 0


def test_small_memos_and_edges_that_are_walked_once(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    walked, walk = [], bpe.Codec._edge
    monkeypatch.setattr(bpe.Codec, "_edge", staticmethod(lambda token, toward: walked.append(token) or walk(token, toward)))
    codec = bpe.Codec(PATH)
    texts = ["enlaouque entreeuxelle outreiertre", "laenqueenelle enpaouq uneaielle " * 3, *ODD]
    for _ in range(2):
        for text in texts:
            assert codec.encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
        assert len(codec.memo) <= 3 and len(codec.old_memo) <= 3 and len(codec.pairs) <= 3
        again, walked[:] = list(walked), []
    assert not again  # the second time, every edge is known

"""The cascade skips patterns that can't match, texts are read once, and workers hold few rows at a time."""

import re

import pyarrow as pa

from tracewell.operators import ner
from tracewell.plans import documents

TEXT = "FIR No. 12/2021 at North Gate Police Station on 01.02.2020: MH12 AB 1234, Rs., paid, Rs. 5,000.50 and 5 kg 'ABC' 9876543210 12345678901 123456789012345 urf Ravi Kumar accused The Mohan Lal"


def test_every_pattern_is_still_tried_where_it_matches():
    for label, p in ner.PATTERNS.items():
        found = [m[0] for m in re.finditer(p, TEXT)]
        assert found and all(re.search(ner.HOLDS[label], x) for x in found), label
    plain = ner.Extractor(ner.Gazetteer())
    plain.first = [(label, re.compile(""), rx) for label, _, rx in plain.first]
    spans = ner.Extractor(ner.Gazetteer()).spans(TEXT)
    assert spans == plain.spans(TEXT) and {"MONEY", "PHONE", "ALIAS", "POLICE_STATION"} <= {label for *_, label in spans}
    assert ner.Extractor(ner.Gazetteer()).spans("Rs.,no more") == [(0, 4, "MONEY")]  # no digit is needed


def test_rows_and_texts_come_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(ner, "BATCH", 3)
    assert [len(b) for b in ner.in_batches(((i,) for i in range(7)), ["x"])] == [3, 3, 1]
    whole = pa.RecordBatch.from_arrays([pa.array(range(150))], ["x"])
    parts = list(ner.slices(iter([whole])))
    assert max(p.num_rows for p in parts) == ner.TEXTS and [x for p in parts for x in p["x"].to_pylist()] == list(range(150))


def test_texts_are_read_once_for_a_score(monkeypatch):
    class Frame:
        def where(self, _):
            return self

    read = []
    monkeypatch.setattr(documents, "regex_entities", lambda s, d: read.append(d) or Frame())
    monkeypatch.setattr(documents, "materialise", lambda df, name: df, raising=False)
    monkeypatch.setattr(documents.evaluate, "entity_prf", lambda gold, found: (gold, found))
    documents.QUERIES["ner_prf"](None, "sf")
    assert read == ["sf"]

"""Evaluations hold against the whole truth, and links look up the whole index."""

from tracewell.plans import documents, network, text


def test_truth_of_link_recall(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(network, "merged_links", lambda s, d: None)
    monkeypatch.setattr(network.links, "evaluate", lambda found, truth: truth)
    assert network.QUERIES["link_recall"](spark, sf_dir).count() == network.places(spark, sf_dir).count() > 0


def test_truth_of_er_evaluation(spark, sf_dir, monkeypatch):
    people = spark.createDataFrame([(i, f"name {i // 2}", "", f"s{i % 3}", "", "") for i in range(1, 60)], "person_id long, full_name string, date_of_birth string, native_state string, native_city string, alias string")
    monkeypatch.setattr(text, "v_people", lambda s, d: people)
    monkeypatch.setattr(text.resolve, "resolve", lambda *a: None)
    monkeypatch.setattr(text.resolve, "evaluate", lambda found, truth: truth)
    rows = text.QUERIES["er_evaluation"](spark, sf_dir).collect()
    assert {(r.record_a, r.record_b) for r in rows} == {(i, i + 1) for i in range(2, 59, 2)}


def test_index_of_ner_link(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(documents.ner, "link", lambda entities, index: index)
    found = {r.id for r in documents.QUERIES["ner_link"](spark, sf_dir).collect()}
    assert found == {r.doc_id for r in documents.regex_entities(spark, sf_dir).where("label = 'ACCOUNT'").collect()}


def test_numbers_are_linked_by_ner_link(spark, sf_dir):
    """names that the normal form leaves nothing of."""
    rows = documents.QUERIES["ner_link"](spark, sf_dir).collect()
    named = {}
    for r in documents.regex_entities(spark, sf_dir).where("label = 'ACCOUNT'").collect():
        named.setdefault(r.text, set()).add(str(r.doc_id))
    orgs = [r for r in rows if r.label == "ORG"]
    assert orgs
    for r in orgs:
        ids = sorted(named[r.text])
        assert (r.entity_id, r.candidates, r.link_confidence) == (ids[0], "|".join(ids[:5]), 1.0 if len(ids) == 1 else 0.5)


def test_what_is_not_found_is_not_linked(spark):
    found = spark.createDataFrame([("ORG", "Acme"), ("ORG", "12345"), ("LOC", "Rome"), ("ORG", "--"), ("DATE", "1")], "label string, text string")
    index = spark.createDataFrame([("ORG", "ACME", 7), ("ORG", " 12345", 8), ("ORG", "12345", 9), ("LOC", "", 1)], "kind string, name string, id long")
    got = {r.text: (r.entity_id, r.candidates, r.link_confidence) for r in documents.ner.link(found, index).collect()}
    assert got == {"Acme": ("7", "7", 1.0), "12345": ("8", "8|9", 0.5), "Rome": ("", "", 0.0), "--": ("", "", 0.0), "1": ("", "", 0.0)}

"""The whole batch over a few literal feeds, and the safety rules of what it writes."""

from tracewell.plans.batch import Batch
from tracewell.sources import sinks
from tracewell.sources.catalog import Catalog, Feed

FEEDS = {
    "persons": "person_id,full_name,alias,date_of_birth,native_state,native_city,syndicate_code,risk_score\nP1,Naseer Ahmed,,1980-01-01,Haryana,Gurugram,A,5\nP2,Om Prakash Bhardwaj,Omi,1979-02-02,Haryana,Gurugram,A,3\nP3,Naseer Ahmad,,1980-01-01,Haryana,Gurugram,B,\nP4,NA,-,,,,,\n",
    "person_person": "src_person_id,dst_person_id,relation,strength,confidence,source_type,is_verified\nP1,P2,REPORTS_TO,0.9,0.8,X,1\nP2,P4,ASSOCIATE_OF,0.5,0.5,X,0\n",
    "person_phone": "person_id,phone_id,usage_type,confidence\nP1,PH1,,1\nP3,PH2,,1\n", "phones": "phone_id,msisdn\nPH1,09876543210\nPH2,9876543211\n",
    "phone_device": "phone_id,device_id,imei,msisdn\nPH1,D,000000000000001,1\nPH2,D,000000000000001,2\n",
    "incidents": "incident_id,crime_type,state,incident_datetime,investigating_agency\nI1,THEFT,Haryana,2021-01-01 10:00:00,Crime Branch\n", "person_incident": "incident_id,person_id,role_in_incident\nI1,P1,ACCUSED\nI1,P3,SUSPECT\n",
    "locations": "location_id,area,city,state\nL1,Sohna,Gurugram,Haryana\n", "organizations": "org_id,name\nO1,Karur Vysya Bank\n",
    "cdr": "cdr_id,caller_phone_id,callee_phone_id,caller_person_id,callee_person_id,timestamp,duration_sec,imei\n1,PH1,PH2,P1,P3,2021-01-01 09:00:00,5,1\n2,PH1,PH2,P3,P1,2021-01-01 09:30:00,5,1\n",
}
ABSENT = ("transactions", "person_account", "person_location", "incident_vehicle", "colocation_observations")


def catalog(spark, tmp_path):
    for name, text in FEEDS.items():
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "fir.jsonl").write_text('{"doc_id": "D1", "text": "It is alleged that Naseer Ahmed and Om Prakash Bhardwaj committed the offence at Sohna, Gurugram on 27.11.2021.", "linked_person_ids": ["P1"]}\n\n')
    return Catalog(spark, [*[Feed(n, f"{tmp_path}/{n}.csv", "SYS", "E") for n in [*FEEDS, *ABSENT]], Feed("fir", f"{tmp_path}/fir.jsonl", kind="json")])


def test_catalog(spark, tmp_path):
    c = catalog(spark, tmp_path)
    p = {r.person_id: r for r in c.persons.collect()}
    assert p["P1"].alias is None and p["P4"].full_name == "NA" and p["P4"].alias == "-" and p["P3"].risk_score is None and p["P1"].risk_score == 5
    assert c["phones"].orderBy("phone_id").first().msisdn == "09876543210"
    assert c["transactions"].count() == 0 and "amount_inr" in c["transactions"].columns
    assert c.documents().count() == 1 and c.summary().where("feed = 'persons'").first().rows == 4
    try:
        c["nothing"]
        raise AssertionError
    except KeyError:
        pass


def test_batch(spark, tmp_path):
    b = Batch(catalog(spark, tmp_path), str(tmp_path / "out"))
    t = {n: spark.read.parquet(p) for n, p in b.run().items()}
    assert {(r.text, r.label, r.entity_id) for r in t["entities"].collect()} >= {("Naseer Ahmed", "PERSON", "P1"), ("Om Prakash Bhardwaj", "PERSON", "P2"), ("Sohna", "LOC", ""), ("27.11.2021", "DATE", "")}
    assert {(r.src, r.dst, r.relation) for r in t["extracted_relations"].collect()} == {("P1", "P2", "CO_ACCUSED_WITH")}
    e = {(r.a, r.b): r.layers for r in t["fused_edges"].collect()}
    assert e == {("P1", "P2"): "intel", ("P2", "P4"): "intel", ("P1", "P3"): "co_event|comm"}
    r = t["resolution_proposals"].collect()
    assert [(x.record_a, x.record_b, x.auto_merged) for x in r] == [("P1", "P3", False)] and r[0].confidence_band in ("MEDIUM", "HIGH")
    link = t["hidden_links"].collect()
    assert [(x.person_a, x.person_b, x.mechanism, x.status, x.requires_human_verification, x.crosses_recorded_groups) for x in link] == [("P1", "P3", "SHARED_HANDSET_IMEI", "UNVERIFIED", True, 1)]
    assert all(x.requires_human_review for x in t["anomalies"].collect())
    assert t["key_players"].count() == 4 and set(b.timings) >= {"fused", "anomalies"}


def test_word_lists_joined(spark, tmp_path):
    b = Batch(catalog(spark, tmp_path), str(tmp_path / "out"), word_lists="joined")
    documents = b.c.documents()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(b._entities(documents)) == rows(Batch(b.c, str(tmp_path / "out"))._entities(documents))


def test_decisions_and_bulk_load(spark, tmp_path):
    path = f"{tmp_path}/log"
    sinks.record_decision(spark, path, "LINK", "LNK1", "CONFIRMED", "me")
    sinks.record_decision(spark, path, "LINK", "LNK2", "DEFERRED", "me", "later")
    assert sorted(r.item_id for r in sinks.decisions(spark, path).collect()) == ["LNK1", "LNK2"] and sinks.decisions(spark, path, 1).first().item_id == "LNK2"
    for f in (lambda: sinks.record_decision(spark, path, "LINK", "x", "MERGED", "me"), lambda: sinks.bulk_nodes(spark.range(2).selectExpr("1 as k"), "k")):
        try:
            f()
            raise AssertionError
        except ValueError:
            pass
    df = spark.createDataFrame([(1, 2, 5), (1, 2, 6)], "s int, d int, x int")
    assert [tuple(r) for r in sinks.bulk_edges(df, "s", "d", total="x").collect()] == [(1, 2, 2, 11)]

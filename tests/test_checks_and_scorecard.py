import random

import pytest

from tracewell.operators import anomaly, checks, scorecard
from tracewell.operators.checks import Holds, Measured, Resolves, Unique


def feeds(spark, **changed):
    """A small sound case dataset; changed: rows in place of a feed's own."""
    make = lambda name, rows, schema: spark.createDataFrame(changed.get(name, rows), schema)
    people = [(f"P{i}", "CRIMINAL", "KINGPIN" if i < 2 else "MULE", 90 if i < 2 else 20) for i in range(20)]
    text = "Ann met Bob"
    return {
        "persons": make("persons", people, "person_id string, person_type string, role string, risk_score int"),
        "person_person": make("person_person", [(f"P{i}", f"P{(i * 7 + k) % 20}") for i in range(20) for k in (1, 2) if (i * 7 + k) % 20 != i], "src_person_id string, dst_person_id string"),
        "person_incident": make("person_incident", [("P1", "I1"), ("P2", "I2")], "person_id string, incident_id string"), "person_phone": make("person_phone", [(f"P{i}", f"T{i}") for i in range(20)], "person_id string, phone_id string"),
        "person_account": make("person_account", [("P3", "A1")], "person_id string, account_id string"), "accounts": make("accounts", [("A1",)], "account_id string"), "locations": make("locations", [("L1",)], "location_id string"),
        "incidents": spark.createDataFrame(changed.get("incidents", [(f"I{i}", "L1", f"20{10 + i}-01-01") for i in range(8)]), "incident_id string, location_id string, t string").selectExpr("incident_id", "location_id", "cast(t as timestamp) as incident_datetime"),
        "phones": make("phones", [(f"T{i}", f"98{i}") for i in range(20)], "phone_id string, msisdn string"), "phone_device": make("phone_device", [(f"T{i % 20}", f"M{i // 2}") for i in range(60)], "phone_id string, imei string"),
        "documents": make("documents", [("D1", text), ("D2", text)], "doc_id string, text string"),
        "annotations": make("annotations", [(d, s, e, text[s:e], f"L{i}") for d in ("D1", "D2") for i, (s, e) in enumerate((k, k + 1) for k in range(11))], "doc_id string, start int, end int, text string, label string"),
        "latent_links": make("latent_links", [(f"X{i}", f"Y{i}", "a", "b", f"m{i % 3}") for i in range(6)], "person_a string, person_b string, syndicate_a string, syndicate_b string, mechanism string"),
        "key_players": make("key_players", [("KINGPIN", "P0"), ("BROKER", "P1")], "key_player_type string, person_id string"), "anomalies": make("anomalies", [(f"p{i}",) for i in range(5)], "pattern string"),
        "duplicate_pairs": make("duplicate_pairs", [("1", "a", "b")] * 51 + [("0", "n", "n")] * 31, "is_same_person string, name_a string, name_b string"),
    }


def audit(spark, **changed):
    own = feeds(spark, **changed)
    component = spark.createDataFrame([(f"P{i}", "P0") for i in range(20)], "id string, component string")
    ranks = spark.createDataFrame([(f"P{i}", i + 1) for i in range(20)], "id string, rank int")
    agreement = spark.createDataFrame([(0.8, 0.6)], "ari double, modularity double")
    return {r.check: r for r in checks.run(checks.record_tables(own, component, agreement, ranks), checks.record_rules()).collect()}


def test_a_sound_dataset(spark):
    got = audit(spark)
    assert len(got) == len(checks.record_rules()) == 33
    assert {c for c, r in got.items() if not r.passed} == {"labels of entities"}  # eleven labels are one short
    assert got["labels of entities"].value == 11 and got["labels of entities"].bound == ">= 12"
    assert got["shared handsets are seen"].value == 30 and got["kingpins surface by betweenness"].value == 1.0


def test_planted_faults_are_counted(spark):
    got = audit(
        spark, person_person=[("P1", "P1"), ("P1", "P2"), ("P2", "nobody"), ("P3", "nobody"), (None, "P1"), ("X1", "Y1")], phones=[("T0", "1"), ("T1", "1"), ("T2", "1"), ("T3", None), ("T4", None)], incidents=[("I1", "L9", "2020-01-01"), ("I1", None, "2020-05-01")],
        annotations=[("D1", 0, 3, "Ann", "P"), ("D1", 2, 3, "n", "P"), ("D1", 4, 99, "met", "P"), ("D2", 0, 3, "Bob", "P"), ("D9", 0, 3, "Ann", "P")], duplicate_pairs=[], anomalies=[],
    )
    n = {c: r.n for c, r in got.items()}
    assert n["person_person.dst_person_id resolves"] == 3 and n["person_person.src_person_id resolves"] == 1 and n["no relation to oneself"] == 2  # null counts as broken
    assert n["one phone a number"] == 2 and n["incidents.location_id resolves"] == 1 and n["person_incident.incident_id resolves"] == 1 and n["person_phone.phone_id resolves"] == 15
    assert (n["spans are in range"], n["spans are as in their texts"], n["spans don't overlap"]) == (2, 3, 1)
    assert n["latent links aren't declared"] == 1 and n["patterns of anomalies"] == 1 and n["true duplicates"] == 1 and n["years of incidents"] == 1 and got["years of incidents"].value == 1


def test_rules_of_empty_tables_and_wrong_names(spark):
    t = {"a": spark.createDataFrame([], "k int, v int"), "b": spark.createDataFrame([(1,)], "k int")}
    rules = [Resolves("r", "a", "k", "b", "k"), Holds("h", "a", "v > 0"), Unique("u", "a", ("k", "v")), Measured("m", "a", "avg(v)", ">=", 1), Resolves("back", "b", "k", "a", "k")]
    assert {(r.check, r.n, r.passed) for r in checks.run(t, rules).collect()} == {("r", 0, True), ("h", 0, True), ("u", 0, True), ("m", 1, False), ("back", 1, False)}
    with pytest.raises(ValueError):
        checks.run(t, [rules[0], rules[0]])
    with pytest.raises(KeyError):
        checks.run(t, [Holds("x", "nothing", "true")])


def test_one_scan_a_table_and_one_join_a_parent(spark):
    t = {"a": spark.range(5).selectExpr("id as k", "id as j", "id as v"), "p": spark.range(3).withColumnRenamed("id", "k")}
    plan = checks.run(t, [Holds("h", "a", "v > 0"), Holds("i", "a", "v < 9"), Measured("m", "a", "max(v)", "=", 4), Unique("u", "a", ("v",)), Resolves("k", "a", "k", "p", "k"), Resolves("j", "a", "j", "p", "k")])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 3") == 1 and text.count("Range (0, 5") == 3  # one scan for all of the table's rules, one for each key
    assert {r.check: r.n for r in plan.collect()} == {"h": 1, "i": 0, "m": 0, "u": 0, "k": 2, "j": 2}


def brute(ranked, truth, ks):
    """ranked: ids in order -> {k: (precision, recall)}, average precision."""
    hits = [i for i, x in enumerate(ranked, 1) if x in truth]
    ap = round(sum((n + 1) / i for n, i in enumerate(hits)) / len(truth), 4) if truth else 0.0
    return {k: (round(sum(i <= k for i in hits) / k, 4), round(sum(i <= k for i in hits) / len(truth), 4) if truth else 0.0) for k in ks if k <= len(ranked)}, ap


@pytest.mark.parametrize("seed", range(2))
def test_grid(spark, seed):
    rng = random.Random(seed)
    orders = {r: rng.sample(range(300), n) for r, n in (("a", 300), ("b", 40), ("c", 7))}
    members = {"few": {3, 5}, "many": set(rng.sample(range(400), 150)), "none": set()}
    rankings = spark.createDataFrame([(r, x, i) for r, ids in orders.items() for i, x in enumerate(ids, 1)], "ranking string, id int, rank int")
    targets = spark.createDataFrame([(t, x) for t, ids in members.items() for x in ids] * 2 + [("few", None)], "target string, id int")
    grid = [(r, t) for r in orders for t in members if (r, t) != ("b", "few")] + [("absent", "few"), ("a", "few")]
    got = scorecard.ranking_grid(rankings, targets, grid, (1, 7, 10, 100)).collect()
    expect = {}
    for r, t in set(grid) - {("absent", "few")}:
        at, ap = brute(orders[r], members[t], (1, 7, 10, 100))
        expect |= {(r, t, k): (p, rec, ap) for k, (p, rec) in at.items()}
    assert {(r.ranking, r.target, r.k): (r.precision, r.recall, r.average_precision) for r in got} == expect and len(got) == len(expect)


def test_card_and_its_lines(spark):
    community = spark.createDataFrame([(i, i // 4) for i in range(8)], "id int, community int")
    truth = spark.createDataFrame([(i, "UNAFFILIATED" if i == 7 else "AB"[i // 4]) for i in range(8)], "id int, label string")
    edges = spark.createDataFrame([(a, b, 1.0) for g in (0, 4) for a in range(g, g + 4) for b in range(a + 1, g + 4)], "a int, b int, weight double")
    row = scorecard.community_card(community, truth, edges).first()
    assert (row.ari, row.nmi, row.modularity, row.communities_found, row.groups_planted) == (1.0, 1.0, 0.5, 2, 2)
    found = spark.createDataFrame([("STRUCTURING", ["x"], ["p"]), ("SHARED_HANDSET", ["y"], [])], "pattern string, entity_ids array<string>, person_ids array<string>")
    planted = spark.createDataFrame([("STRUCTURING", "x|z"), ("STRUCTURING", "x|z"), ("STRUCTURING", "q"), ("BURNER_SIM_ROTATION", "y"), ("LAYERING", None)], "pattern string, entity_ids string")
    scored = anomaly.evaluate(found, planted)
    assert {(r.pattern, r.planted, r.detected) for r in scored.collect()} == {("STRUCTURING", 3, 2), ("BURNER_SIM_ROTATION", 1, 1), ("LAYERING", 1, 0), ("_overall", 5, 3)}
    card = scorecard.card(communities=scorecard.community_card(community, truth, edges), anomalies=scored)
    values = {(r.section, r.item, r.measure): r.value for r in card.collect()}
    assert values["communities", "found against planted", "ari"] == 1.0 and values["anomalies", "_overall", "detected"] == 3.0
    text = scorecard.lines(card)
    assert text[0] == "ANOMALIES" and any("ari=1" in x for x in text) and "no link is confirmed" in text[-1]
    with pytest.raises(ValueError):
        scorecard.card()

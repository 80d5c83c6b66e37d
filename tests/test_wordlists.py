import random
import re

from tracewell.operators import ner, wordlists

CITIES, AREAS = ["Gorakhpur", "Jabalpur", "New Delhi", "Delhi", "Ångs", "St. Ives."], ["Gorakhpur", "Sohna", "Delhi", "Old-Town"]


def texts(rng: random.Random, names: list[str], n: int) -> list[str]:
    filler = ["seen at", "went to", "r/o", "accused", "and", "the", "of", ",", ".", "\n", "  ", "urf", "Police Station", "27.11.2021", "met", "x", "'", "@", "Delhi6", "situated at", "é", "𝒳"]
    out = []
    for _ in range(n):
        parts = [rng.choice(rng.choice([CITIES, AREAS, filler, filler, names, ["Enforcement Directorate", "Enforcement", "Karur Vysya Bank", "Bank"]])) for _ in range(rng.randint(1, 40))]
        out.append(rng.choice([" ", " ", ", "]).join(parts))
    return out


def test_equals_the_cascade_with_many_names(spark):
    """1,000 texts, 100,000 names."""
    rng = random.Random(4)
    made = sorted({"".join(rng.choice("abcdeiklmnorstu") for _ in range(rng.randint(3, 8))).title() for _ in range(40_000)})
    names = [f"{rng.choice(made)} {rng.choice(made)}" for _ in range(100_000)]
    orgs = ["Enforcement Directorate", "Karur Vysya Bank", *(f"{a} Traders" for a in made[:20_000])]
    g = ner.Gazetteer(
        agencies=frozenset({"Enforcement Directorate", "Enforcement"}), orgs=frozenset(orgs), cities=frozenset(CITIES), areas=frozenset(AREAS),
        names=frozenset(ner.S.py_normalize(n) for n in names), tokens=frozenset(w.lower() for n in names for w in n.split() if len(w) > 2),
    )
    written = texts(rng, [*names[:300], *orgs[:60], "Zzyx Qwrt"], 1000) + ["", None, "Gorakhpur"]
    docs = spark.createDataFrame([(i % 997 if i % 50 else None, t, i) for i, t in enumerate(written)], "doc_id long, text string, start int")
    words = [("AGENCY", x) for x in g.agencies] + [("ORG", x) for x in orgs] + [("GPE", x) for x in CITIES] + [("LOC", x) for x in AREAS] + [("LOC", None), ("LOC", " - "), ("GPE", " Delhi ")]
    got = wordlists.extract(docs.repartition(3), spark.createDataFrame(words, "label string, value string"), spark.createDataFrame([(n,) for n in [*names, None]], "full_name string"))
    expect = ner.extract(docs, g)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = rows(got)
    assert found == rows(expect) and {r[4] for r in found} >= {"AGENCY", "ORG", "GPE", "LOC", "PERSON", "ALIAS", "DATE"}


def test_places_of_overlapping_values(spark):
    values = ["a b", "b c", "b", "é", "c.", "(a", "a b c d"]
    written = ["a b c d", "ab b cé é", "c. c.x (a b x(a", "", None, "a  b", "b" * 9, "b " * 3000]
    docs = spark.createDataFrame([(1, t) for t in written], "doc_id long, text string")
    got = sorted((r.value, r.start, r.end) for r in wordlists.places(docs, spark.createDataFrame([(v, "L") for v in values + values], "value string, label string")).collect())
    expect = sorted((v, m.start(), m.start() + len(v)) for t in written if t for v in values for m in re.finditer(rf"(?<!\w)(?={re.escape(v)}(?!\w))", t))
    assert got == expect and len(got) > 3000


def test_empty_lists_and_tables(spark):
    docs, none = spark.createDataFrame([("d", "seen at Delhi on 27.11.2021")], "doc_id string, text string"), spark.createDataFrame([], "label string, value string")
    assert [(r.doc_id, r.text, r.label) for r in wordlists.extract(docs, none).collect()] == [("d", "27.11.2021", "DATE")]
    assert wordlists.places(docs, none).count() == 0 and wordlists.extract(docs.limit(0), none).count() == 0

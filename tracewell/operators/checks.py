"""Checks of a dataset as data: rules over named tables, compiled to one aggregation a table and one anti-join a parent key.

A rule gives a row check, kind, n, value, bound, passed. n counts what breaks the rule (rows, or repeats beyond the first);
a measured rule has its value and bound, and n is 0 or 1. A rule of an empty table has nothing that breaks it; a measure
without a value fails. Tables are only read: give derived ones (a graph's topology, spans with their texts) as tables too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Resolves:
    """Every non-null key is one of the parent's."""

    check: str
    table: str
    key: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class Holds:
    """A SQL condition is true in every row; null counts as broken."""

    check: str
    table: str
    condition: str


@dataclass(frozen=True)
class Unique:
    """No two rows have the same non-null keys; n counts the rows beyond the first of each."""

    check: str
    table: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Measured:
    """A SQL aggregate over the table stands to a bound as it must: >=, > , <=, < or =."""

    check: str
    table: str
    value: str
    must: str
    bound: float


Rule = Resolves | Holds | Unique | Measured
BOUNDS = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__, "=": Column.__eq__}
ROW = "check string, kind string, n long, value double, bound string"


def _in_one_pass(rule: Rule) -> Column:
    """A rule's row as an aggregate over its table."""
    none = F.lit(None)
    if isinstance(rule, Holds):
        n, value, bound = F.count_if(~F.coalesce(F.expr(rule.condition), F.lit(False))), none.cast("double"), none.cast("string")
    elif isinstance(rule, Unique):
        keys = [F.col(k) for k in rule.keys]
        n, value, bound = F.count(F.when(F.concat(*[k.cast("string") for k in keys]).isNotNull(), 1)) - F.count_distinct(*keys), none.cast("double"), none.cast("string")
    else:
        value = F.expr(rule.value).cast("double")
        n, bound = F.when(BOUNDS[rule.must](value, F.lit(float(rule.bound))), 0).otherwise(1), F.lit(f"{rule.must} {rule.bound:g}")
    return F.struct(F.lit(rule.check).alias("check"), F.lit(type(rule).__name__.lower()).alias("kind"), n.cast("long").alias("n"), value.alias("value"), bound.alias("bound"))


def _unresolved(tables: Mapping[str, DataFrame], rules: list[Resolves]) -> DataFrame:
    """The rows of rules that share a parent key: their keys are counted together, and meet the parent's once.

    An outer join, since an anti-join would be pushed below the count and the union, to one for each rule.
    """
    spark = next(iter(tables.values())).sparkSession
    parent = tables[rules[0].parent].select(F.col(rules[0].parent_key).cast("string").alias("key")).where("key IS NOT NULL").distinct().withColumn("there", F.lit(1))
    keys = None
    for r in rules:
        own = tables[r.table].select(F.lit(r.check).alias("check"), F.col(r.key).cast("string").alias("key")).where("key IS NOT NULL")
        keys = own if keys is None else keys.unionByName(own)
    broken = keys.groupBy("key", "check").agg(F.count("*").alias("n")).join(parent, "key", "left").where("there IS NULL").groupBy("check").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(r.check,) for r in rules], "check string")
    return every.join(broken, "check", "left").select("check", F.lit("resolves").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("bound"))


def run(tables: Mapping[str, DataFrame], rules: Iterable[Rule]) -> DataFrame:
    """check, kind, n, value, bound, passed of every rule. A name that tables don't have, or two rules of one name, is an error."""
    rules = list(rules)
    if len({r.check for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    scans: dict[str, list[Rule]] = defaultdict(list)
    joins: dict[tuple[str, str], list[Resolves]] = defaultdict(list)
    for r in rules:
        joins[r.parent, r.parent_key].append(r) if isinstance(r, Resolves) else scans[r.table].append(r)
    parts = [tables[name].agg(F.array(*map(_in_one_pass, own)).alias("rows")).select(F.inline("rows")) for name, own in scans.items()]
    parts += [_unresolved(tables, own) for own in joins.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("n") == 0)


def spans_in_texts(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, start, end, label, in_range, as_in_text, apart of spans (doc_id, start, end, text, label) in documents (doc_id, text).

    apart: the span before it in its document ends first. A span without a document is in no range.
    """
    j = spans.join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id", "left")
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    in_range = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("whole"))
    return j.select(
        "doc_id", "start", "end", "label", F.coalesce(in_range, F.lit(False)).alias("in_range"),
        F.coalesce(F.substr("whole", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text"), F.lit(False)).alias("as_in_text"), F.coalesce(before <= F.col("start"), F.lit(True)).alias("apart"),
    )


def topology(edges: DataFrame, nodes: DataFrame, component: DataFrame) -> DataFrame:
    """One row n_nodes, n_edges, giant, giant_share, average_degree, components of edges a, b between nodes id; component: id, component."""
    own = nodes.select("id").distinct()
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(own.withColumnRenamed("id", "a"), "a", "left_semi").join(own.withColumnRenamed("id", "b"), "b", "left_semi")
    sizes = own.join(component, "id", "left").groupBy(F.coalesce("component", "id").alias("c")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.sum("n").alias("n_nodes"), F.max("n").alias("giant"), F.count("*").alias("components"))
    return found.crossJoin(e.agg(F.count("*").alias("n_edges"))).select(
        "n_nodes", "n_edges", "giant", F.try_divide("giant", "n_nodes").alias("giant_share"), F.try_divide(2 * F.col("n_edges"), "n_nodes").alias("average_degree"), "components")


def surfacing(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """target, share: how many of each target's members (target, id) are among the tenth of scores (id, rank) that ranks first."""
    tenth = scores.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("last"))
    ranked = targets.distinct().join(scores, "id").crossJoin(F.broadcast(tenth))
    return ranked.groupBy("target").agg((F.count_if(F.col("rank") <= F.col("last")) / F.count("*")).alias("share"))


def record_rules() -> list[Rule]:
    """The checks of a case dataset, by the names of its feeds and of the derived tables that they need.

    Derived: `spans` (spans_in_texts), `per_document` (doc_id, spans), `topology`, `agreement` (ari, modularity), `surfacing`,
    `handsets` (imei, subscribers), `leaked` (latent links with a declared relation), `role_risk` (role, risk).
    """
    endpoints = [
        ("person_person", "src_person_id", "persons", "person_id"), ("person_person", "dst_person_id", "persons", "person_id"), ("person_incident", "person_id", "persons", "person_id"),
        ("person_incident", "incident_id", "incidents", "incident_id"), ("person_phone", "person_id", "persons", "person_id"), ("person_phone", "phone_id", "phones", "phone_id"),
        ("person_account", "person_id", "persons", "person_id"), ("person_account", "account_id", "accounts", "account_id"), ("incidents", "location_id", "locations", "location_id"),
    ]
    return [
        *[Resolves(f"{t}.{k} resolves", t, k, p, pk) for t, k, p, pk in endpoints],
        Holds("no relation to oneself", "person_person", "src_person_id <> dst_person_id"), Unique("one phone a number", "phones", ("msisdn",)),
        Holds("spans are in range", "spans", "in_range"), Holds("spans are as in their texts", "spans", "as_in_text"), Holds("spans don't overlap", "spans", "apart"),
        Measured("labels of entities", "spans", "count(distinct label)", ">=", 12), Measured("entities a document", "per_document", "avg(spans)", ">=", 8),
        Measured("most criminals in one component", "topology", "max(giant_share)", ">", 0.75), Measured("average degree is not too low", "topology", "max(average_degree)", ">=", 3), Measured("average degree is not too high", "topology", "max(average_degree)", "<=", 15),
        Measured("communities recover the groups", "agreement", "max(ari)", ">", 0.45), Measured("modularity shows communities", "agreement", "max(modularity)", ">", 0.4),
        Measured("kingpins surface by betweenness", "surfacing", "max(share) filter (where target = 'KINGPIN')", ">=", 0.4), Measured("brokers surface by betweenness", "surfacing", "max(share) filter (where target = 'BROKER')", ">=", 0.4),
        Measured("latent links aren't declared", "leaked", "count(*)", "=", 0), Measured("latent links cross groups", "latent_links", "avg(case when syndicate_a <> syndicate_b then 1 else 0 end)", ">", 0.8),
        Measured("mechanisms of latent links", "latent_links", "count(distinct mechanism)", ">=", 3), Measured("shared handsets are seen", "handsets", "count_if(subscribers > 1)", ">=", 20),
        Measured("patterns of anomalies", "anomalies", "count(distinct pattern)", ">=", 5), Measured("true duplicates", "duplicate_pairs", "count_if(is_same_person = '1')", ">", 50),
        Measured("hard negatives", "duplicate_pairs", "count_if(is_same_person = '0')", ">", 30), Measured("hard negatives with one name", "duplicate_pairs", "count_if(is_same_person = '0' and name_a = name_b)", ">", 20),
        Measured("risk follows the role", "role_risk", "avg(risk) filter (where role = 'KINGPIN') - avg(risk) filter (where role = 'MULE')", ">", 25), Measured("years of incidents", "incidents", "count(distinct year(incident_datetime))", ">=", 7),
    ]


def record_tables(feeds: Mapping[str, DataFrame], component: DataFrame, agreement: DataFrame, by_betweenness: DataFrame) -> dict[str, DataFrame]:
    """feeds with the derived tables that record_rules needs, but for those that rest on other results.

    component: id, component of the criminals' relations; agreement: ari, modularity; by_betweenness: id, rank.
    """
    relations = feeds["person_person"].select(F.col("src_person_id").alias("a"), F.col("dst_person_id").alias("b"))
    criminals = feeds["persons"].where("person_type = 'CRIMINAL'").select(F.col("person_id").alias("id"))
    declared = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    latent = feeds["latent_links"].withColumns({"a": F.least("person_a", "person_b"), "b": F.greatest("person_a", "person_b")})
    owner = feeds["person_phone"].groupBy("phone_id").agg(F.max("person_id").alias("owner"))
    spans = spans_in_texts(feeds["annotations"], feeds["documents"])
    return dict(feeds) | {
        "spans": spans, "per_document": feeds["documents"].select("doc_id").join(spans, "doc_id", "left").groupBy("doc_id").agg(F.count("start").alias("spans")),
        "topology": topology(relations, criminals, component), "agreement": agreement, "surfacing": surfacing(by_betweenness, feeds["key_players"].select(F.col("key_player_type").alias("target"), F.col("person_id").alias("id"))),
        "leaked": latent.join(declared, ["a", "b"], "left_semi"), "handsets": feeds["phone_device"].join(owner, "phone_id").groupBy("imei").agg(F.count_distinct("owner").alias("subscribers")),
        "role_risk": feeds["persons"].select("role", F.col("risk_score").alias("risk")),
    }

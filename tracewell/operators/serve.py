"""What an application asks for: search, dossiers, neighbourhoods, filtered lists with facets. All return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import strings as S
from tracewell.operators.centrality import both_ways, inside


def search(q: str, persons: DataFrame, phones: DataFrame | None = None, accounts: DataFrame | None = None, vehicles: DataFrame | None = None, orgs: DataFrame | None = None, limit: int = 25) -> DataFrame:
    """kind, id, label, score of what q finds, the best first. Tables: id, label (persons also alias)."""
    low, digits, plate = q.strip().lower(), "".join(c for c in q if c.isdigit()), q.upper().replace(" ", "")
    normal = S.py_normalize(q)
    has = lambda c, v: F.contains(c, F.lit(v))
    score = F.when(has(S.normalize("label"), normal), 0.95).when(has(F.lower(F.coalesce("alias", F.lit(""))), low), 0.9)
    # names alike share a word's first letter at least: the others are not compared
    starts = [t[0] for t in normal.split()]
    near = F.exists(F.split(S.normalize("label"), " "), lambda t: F.substring(t, 1, 1).isin(*starts)) if starts else F.lit(False)
    people = persons.select("id", "label", score.alias("s"), near.alias("near")) if normal else persons.limit(0).select("id", "label", F.lit(None).cast("double").alias("s"), F.lit(False).alias("near"))
    sure = people.where("s is not null").select("id", "label", "s")
    alike = people.where("s is null and near").withColumn("s", S.name_similarity(F.lit(q), F.col("label"))).where("s > 0.8").select("id", "label", "s")
    parts = [sure.unionByName(alike).select(F.lit("person").alias("kind"), F.col("id").cast("string").alias("id"), "label", F.round("s", 4).alias("score"))]

    def add(kind: str, df: DataFrame | None, hit: Column, value: float) -> None:
        if df is not None:
            parts.append(df.where(hit).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.lit(value).alias("score")))

    if digits:
        add("phone", phones, has(F.col("label").cast("string"), digits), 0.9)
        add("account", accounts, has(F.col("label").cast("string"), digits), 0.9)
    add("vehicle", vehicles, has(F.replace(F.upper("label"), F.lit(" "), F.lit("")), plate), 0.9)
    add("organization", orgs, has(F.lower("label"), low), 0.85)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("score"), "kind", "id").limit(limit)


def ego(edges: DataFrame, focus, depth: int = 1, min_corroboration: int = 1, limit: int | None = 120, influence: DataFrame | None = None) -> DataFrame:
    """id, hop of the nodes within depth hops over edges of enough corroboration; the nearest first, then the most influential. limit None: all."""
    e = edges.where(F.col("corroboration") >= min_corroboration) if "corroboration" in edges.columns else edges
    e = both_ways(e.withColumn("weight", F.lit(1.0)))
    kind = dict(edges.dtypes)["a"]
    seen = frontier = edges.sparkSession.createDataFrame([(focus, 0)], f"id {kind}, hop int")
    for hop in range(1, depth + 1):
        frontier = frontier.join(e, frontier.id == e.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    if influence is not None:
        seen = seen.join(influence.select("id", F.col("influence_score").alias("_i")), "id", "left")
    order = [F.asc("hop"), *([F.desc_nulls_last("_i")] if influence is not None else []), F.asc("id")]
    return (seen.orderBy(*order) if limit is None else seen.orderBy(*order).limit(limit)).select("id", "hop")


def subgraph(edges: DataFrame, vertices: DataFrame, min_corroboration: int = 2, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): the most influential vertices (id, influence_score) and the edges between them."""
    top = vertices.orderBy(F.desc("influence_score"), "id").limit(limit)
    return top, inside(edges.where(F.col("corroboration") >= min_corroboration), top.select("id"))


def filtered(df: DataFrame, limit: int, order: str, contains: dict[str, str] | None = None, least: dict[str, float] | None = None, **equal) -> DataFrame:
    """Rows where columns equal, contain or reach the values given (None: any), by falling order."""
    for c, v in equal.items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        df = df.where(F.contains(F.col(c), F.lit(v)))
    for c, v in (least or {}).items():
        df = df.where(F.col(c) >= v)
    return df.orderBy(F.desc(order)).limit(limit)


def facet(df: DataFrame, column: str, separator: str | None = None) -> DataFrame:
    """value, n over all rows; a column of joined values counts each."""
    value = F.explode(F.split(column, separator)) if separator else F.col(column)
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def dossier(person, persons: DataFrame, phones: DataFrame, accounts: DataFrame, incidents: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: the person with phones, accounts, at most 40 incidents (the newest first) and relations with their direction.

    phones, accounts: person_id, id; incidents: person_id, incident, ts; relations: src, dst, relation.
    """
    me = lambda df: df.where(F.col("person_id") == F.lit(person))
    joined = lambda df, c: df.agg(F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), "|").alias(c))
    p = joined(me(phones).select(F.col("id").alias("phones")), "phones")
    a = joined(me(accounts).select(F.col("id").alias("accounts")), "accounts")
    newest = me(incidents).orderBy(F.desc("ts"), F.desc("incident")).limit(40)
    i = newest.agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "incident")))), lambda x: x.incident.cast("string")), "|").alias("incidents"))
    out = relations.where(F.col("src") == F.lit(person)).select(F.concat_ws(" ", F.lit("->"), "relation", F.col("dst").cast("string")).alias("r"))
    back = relations.where(F.col("dst") == F.lit(person)).select(F.concat_ws(" ", F.lit("<-"), "relation", F.col("src").cast("string")).alias("r"))
    r = joined(out.unionByName(back).select(F.col("r").alias("relations")), "relations")
    return me(persons).crossJoin(p).crossJoin(a).crossJoin(i).crossJoin(r)


def documents_of(documents: DataFrame, person_id: str | None = None, doc_id=None, limit: int = 20) -> DataFrame:
    """Documents by id or linked person, without their entities."""
    df = documents.drop("entities")
    if doc_id is not None:
        return df.where(F.col("doc_id") == doc_id)
    return (df if person_id is None else df.where(F.array_contains("linked_person_ids", person_id))).orderBy("doc_id").limit(limit)

"""Evidence layers, their fusion into one weighted graph, and the heterogeneous projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.conf import Layers
from tracewell.operators.ordering import quantile
from tracewell.operators.pairing import paired
from tracewell.sources.storage import materialise

CONF = Layers()


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with a < b instead of direction; rows without both ends and loops go."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).withColumns({"a": F.least(x, y), "b": F.greatest(x, y)})


def _joined(c: Column | str, most: int | None = None) -> Column:
    """A set as sorted text, cut to its first members."""
    s = F.sort_array(F.collect_set(c))
    return F.array_join((F.slice(s, 1, most) if most else s).cast("array<string>"), "|")


def intel_layer(rel: DataFrame) -> DataFrame:
    """Declared relations src, dst, relation, strength, confidence, verified -> one undirected edge for each pair."""
    return _pairs(rel, "src", "dst").groupBy("a", "b").agg(
        F.round(F.max(F.col("strength") * F.col("confidence")), 4).alias("weight"), _joined("relation").alias("relations"),
        F.count("*").alias("n_records"), F.max("verified").alias("verified"),
    )


def comm_layer(calls: DataFrame, min_calls: int = CONF.min_calls) -> DataFrame:
    """Calls caller, callee, dur -> pairs with at least min_calls; weight by log of calls against the busiest pair."""
    kept = _pairs(calls, "caller", "callee").groupBy("a", "b").agg(F.count("*").alias("calls"), F.round(F.sum("dur"), 2).alias("total_dur")).where(F.col("calls") >= min_calls)
    kept = materialise(kept, "called")  # read twice
    top = kept.agg(F.max("calls").alias("top"))
    return kept.crossJoin(F.broadcast(top)).select("a", "b", "calls", "total_dur", F.round(F.log1p("calls") / F.log1p("top"), 4).alias("weight"))


def money_layer(tx: DataFrame, pct: float = CONF.money_quantile) -> DataFrame:
    """Directed payment pairs that repeat or are material (total at or above the pct quantile of totals)."""
    pairs = (
        tx.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))
    )
    pairs = materialise(pairs, "paid")  # read for the cutoff, the largest total and the rows
    cut = quantile(pairs, "total", pct, "cutoff")
    kept = pairs.crossJoin(F.broadcast(cut)).where((F.col("n") >= 2) | (F.col("total") >= F.col("cutoff")))
    top = kept.agg(F.max("total").alias("top"))
    return kept.crossJoin(F.broadcast(top)).select("src", "dst", "total", "n", F.round(F.log1p("total") / F.log1p("top"), 4).alias("weight"))


def undirected_money(money: DataFrame) -> DataFrame:
    """Of two directions between a pair the larger total stands; of equal ones the one from the smaller id."""
    best = F.struct("total", (F.col("src") < F.col("dst")).alias("up"))
    return _pairs(money, "src", "dst").groupBy("a", "b").agg(F.max_by("weight", best).alias("weight"), F.max_by("total", best).alias("total"), F.max_by("n", best).alias("n"))


def co_event_layer(participants: DataFrame) -> DataFrame:
    """Participants incident, person -> pairs with n_incidents and weight n/3 up to 1."""
    p = participants.where("incident is not null and person is not null").select("incident", "person").distinct()
    return paired(p, ["incident"], "person").withColumnsRenamed({"a_person": "a", "b_person": "b"}).groupBy("a", "b").agg(
        F.count("*").alias("n_incidents"), _joined("incident", 10).alias("incident_ids"), F.round(F.least(F.lit(1.0), F.count("*") / 3), 4).alias("weight")
    )


def co_place_layer(presence: DataFrame, explicit: DataFrame | None = None, conf: Layers = CONF) -> DataFrame:
    """Presence person, place, bucket -> pairs that share buckets of a few people; explicit: person_a, person_b, confidence, _row.

    An explicit pair starts from its last confidence, a derived one from place_start; each further bucket adds place_step.
    """
    low, high = conf.bucket_people
    p = presence.where("person is not null and place is not null and bucket is not null").select("place", "bucket", "person").distinct()
    few = p.groupBy("place", "bucket").agg(F.count("*").alias("people")).where(F.col("people").between(low, high))
    few = p.join(few.select("place", "bucket"), ["place", "bucket"], "left_semi")
    left, right = few.withColumnRenamed("person", "a"), few.withColumnRenamed("person", "b")
    derived = left.join(right, ["place", "bucket"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"), F.collect_set("place").alias("places"))
    if explicit is None:
        start, seen = F.lit(None).cast("double"), derived
    else:
        said = _pairs(explicit, "person_a", "person_b").groupBy("a", "b").agg(F.max_by("confidence", "_row").alias("said"))
        seen, start = derived.join(said, ["a", "b"], "full"), F.col("said")
    k = F.coalesce("k", F.lit(0))
    weight = F.when(start.isNotNull(), F.least(F.lit(1.0), start + conf.place_step * k)).otherwise(F.least(F.lit(1.0), conf.place_start + conf.place_step * (k - 1)))
    places = F.array_join(F.slice(F.sort_array(F.coalesce("places", F.array())), 1, 10).cast("array<string>"), "|")
    return seen.select("a", "b", (k + start.isNotNull().cast("int")).cast("long").alias("n_observations"), places.alias("location_ids"), F.round(weight, 4).alias("weight"))


def layer_rows(layers: dict[str, DataFrame]) -> DataFrame:
    """Layers as rows a, b, layer, weight, n_incidents."""
    out = None
    for name, df in layers.items():
        n = F.col("n_incidents") if "n_incidents" in df.columns else F.lit(0).cast("long")
        part = df.select("a", "b", F.lit(name).alias("layer"), F.col("weight").cast("double").alias("weight"), n.cast("long").alias("n_incidents"))
        out = part if out is None else out.unionByName(part)
    return out


def fuse(rows: DataFrame, persons: DataFrame | None = None, conf: Layers = CONF) -> tuple[DataFrame, DataFrame]:
    """(edges, leads) of layer rows. Structural layers and repeated co-events assert an edge; the others only add to one.

    edges: a, b, raw_weight, weight, layers, corroboration. leads: a, b, layer, weight of pairs that nothing asserts.
    """
    if persons is not None:
        ids = persons.select(F.col("person_id").alias("a")).distinct()
        rows = rows.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi")
    asserts = F.col("layer").isin(*conf.structural) | ((F.col("layer") == "co_event") & (F.col("n_incidents") >= conf.strong_co_event))
    share = F.lit(None).cast("double")
    for name, w in conf.weights.items():
        share = F.when(F.col("layer") == name, F.col("weight") * w).otherwise(share)
    # one pass: a pair's rows meet once, in the aggregation, and say whether anything asserts it
    pairs = rows.groupBy("a", "b").agg(
        F.max(asserts).alias("asserted"), F.sum(share.cast("decimal(20,8)")).alias("raw"), F.array_join(F.sort_array(F.collect_set("layer")), "|").alias("layers"),
        F.count("*").alias("corroboration"), F.collect_list(F.struct("layer", "weight")).alias("parts"),
    )
    pairs = materialise(pairs, "fused")  # the layers would be worked out again for the largest weight
    top = pairs.where("asserted").agg(F.max("raw").alias("top"))
    edges = pairs.where("asserted").crossJoin(F.broadcast(top)).select(
        "a", "b", F.round("raw", 4).cast("double").alias("raw_weight"), F.round(F.col("raw").cast("double") / F.col("top").cast("double"), 4).alias("weight"), "layers", "corroboration"
    )
    leads = pairs.where("not asserted").select("a", "b", F.explode("parts").alias("p")).select("a", "b", "p.layer", "p.weight")
    return edges, leads


def corroboration_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("corroboration").agg(F.count("*").alias("n_edges"))


def with_vertex_attributes(vertices: DataFrame, persons: DataFrame, attributes: list[str]) -> DataFrame:
    """Vertices id with persons' attributes; missing text is empty, a missing risk is 0."""
    kept = persons.select(F.col("person_id").alias("id"), *attributes)
    out = vertices.join(kept, "id", "left")
    return out.select("id", *[F.coalesce(F.col(c), F.lit(0 if dict(kept.dtypes)[c] in ("int", "bigint", "double") else "")).alias(c) for c in attributes])


def hetero(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes {type: id, label} and edges {type: src, dst} as (id, node_type, label) and (src, dst, edge_type).

    Ids are text with their type's prefix given by the caller. An edge stays if both ends exist; repeats collapse. An id that
    several rows have keeps the first type that has it, and that type's least label.
    """
    v = e = None
    for order, (kind, df) in enumerate(nodes.items()):
        part = df.select(F.col("id").cast("string").alias("id"), F.struct(F.lit(order).alias("order"), F.col("label").cast("string").alias("label"), F.lit(kind).alias("node_type")).alias("row"))
        v = part if v is None else v.unionByName(part)
    v = v.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.node_type", "row.label")
    for kind, df in edges.items():
        part = df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(kind).alias("edge_type"))
        e = part if e is None else e.unionByName(part)
    ids = v.select("id")
    e = e.dropDuplicates().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return v, e.select("src", "dst", "edge_type")


def projection(calls: DataFrame, tx: DataFrame) -> DataFrame:
    """Flat aggregated edges: COMMUNICATES_WITH by log of count, TRANSFERS_TO by log of thousands."""
    c = calls.where("caller is not null and callee is not null").groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("n"))
    t = tx.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))
    return c.select("src", "dst", F.lit("COMMUNICATES_WITH").alias("edge_type"), "n", F.round(F.log1p("n"), 4).alias("weight")).unionByName(
        t.select("src", "dst", F.lit("TRANSFERS_TO").alias("edge_type"), "n", F.round(F.log1p(F.col("total") / 1000), 4).alias("weight"))
    )

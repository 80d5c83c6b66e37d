"""The scorecard: every evaluation as rows section, item, measure, value, and the grid of rankings by targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.centrality import modularity
from tracewell.operators.evaluate import ari_nmi

KS = (10, 25, 50, 100)
#: Which ranking is held against whom.
GRID = (("influence", "ANY_KEY_PLAYER"), ("command", "KINGPIN"), ("command", "LIEUTENANT"), ("broker", "BROKER"))
BUCKETS = 64


def ranking_grid(rankings: DataFrame, targets: DataFrame, grid: Sequence[tuple[str, str]] = GRID, ks: Sequence[int] = KS) -> DataFrame:
    """ranking, target, k, precision, recall, average_precision of every pair of grid, for each k that the ranking reaches.

    rankings: ranking, id, rank from 1; targets: target, id. All pairs are scored in one pass: targets meet the rankings once,
    and only hits go on. The place of a hit among its pair's hits is that within its bucket of ranks plus the hits of the
    buckets before, so no pair's hits are put in order in one task. A target without members has recall 0.
    """
    spark = rankings.sparkSession
    pairs = F.broadcast(spark.createDataFrame(list(dict.fromkeys(map(tuple, grid))), "ranking string, target string"))
    reach = rankings.groupBy("ranking").agg(F.max("rank").alias("last"))
    members = targets.where("id IS NOT NULL").select("target", "id").distinct()
    total = members.groupBy("target").agg(F.count("*").alias("total"))
    hits = members.join(pairs, "target").join(rankings.select("ranking", "id", "rank"), ["ranking", "id"]).join(reach, "ranking")
    hits = hits.select("ranking", "target", "rank", F.floor((F.col("rank") - 1) * BUCKETS / F.col("last")).alias("bucket"))
    pair = ["ranking", "target"]
    ahead = Window.partitionBy(*pair).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a pair
    before = hits.groupBy(*pair, "bucket").agg(F.count("*").alias("n")).select(*pair, "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    found = hits.join(before, [*pair, "bucket"]).withColumn("found", F.col("before") + F.row_number().over(Window.partitionBy(*pair, "bucket").orderBy("rank")))
    at = [F.struct(F.lit(k).cast("long").alias("k"), F.count_if(F.col("rank") <= k).alias("hits")) for k in ks]
    scored = found.groupBy(*pair).agg(F.sum(F.col("found") / F.col("rank")).alias("ap"), F.array(*at).alias("at"))
    none = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(0).cast("long").alias("hits")) for k in ks])
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    rows = pairs.join(reach, "ranking").join(total, "target", "left").join(scored, pair, "left").select(*pair, "last", "total", "ap", F.inline(F.coalesce("at", none)))
    return rows.where("k <= last").select(*pair, "k", zero(F.col("hits"), F.col("k")).alias("precision"), zero(F.col("hits"), F.col("total")).alias("recall"), zero(F.col("ap"), F.col("total")).alias("average_precision"))


def community_card(community: DataFrame, truth: DataFrame, edges: DataFrame, leave_out: str = "UNAFFILIATED") -> DataFrame:
    """One row ari, nmi, modularity, communities_found, groups_planted. community: id, community; truth: id, label; edges: a, b, weight."""
    both = community.select("id", "community").join(truth.select("id", "label"), "id")
    kept = both.where(F.col("label").isNotNull() & (F.col("label") != leave_out))
    found = community.agg(F.count_distinct("community").alias("communities_found"))
    planted = kept.agg(F.count_distinct("label").alias("groups_planted"))
    return ari_nmi(kept, "label", "community", None).crossJoin(modularity(edges, community)).crossJoin(found).crossJoin(planted)


def _long(df: DataFrame, section: str, item: Column, measures: Sequence[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.inline(values))


def card(rankings: DataFrame | None = None, communities: DataFrame | None = None, entities: DataFrame | None = None, resolution: DataFrame | None = None, anomalies: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """section, item, measure, value of the evaluations that are given; the others' sections are left out.

    rankings: ranking_grid; communities: community_card; entities: evaluate.entity_prf; resolution: resolve.evaluate; anomalies:
    anomaly.evaluate; links: links.evaluate.
    """
    parts = []
    if entities is not None:
        parts.append(_long(entities, "entity extraction", F.concat_ws(" ", "level", "label"), ["precision", "recall", "f1", "support"]))
    if rankings is not None:
        whole = rankings.groupBy("ranking", "target").agg(F.max("average_precision").alias("average_precision"))
        pair = F.concat_ws(" against ", "ranking", "target")
        parts += [_long(whole, "rankings", pair, ["average_precision"]), rankings.select(F.lit("rankings").alias("section"), pair.alias("item"), F.inline(F.array(*[F.struct(F.concat(F.lit(f"{m}@"), "k").alias("measure"), F.col(m).alias("value")) for m in ("precision", "recall")])))]
    if communities is not None:
        parts.append(_long(communities, "communities", F.lit("found against planted"), ["ari", "nmi", "modularity", "communities_found", "groups_planted"]))
    for section, df, by in (("resolution", resolution, "level"), ("anomalies", anomalies, "pattern"), ("hidden links", links, "mechanism")):
        if df is not None:
            parts.append(_long(df, section, F.col(by), [c for c, t in df.dtypes if c != by and t in ("int", "bigint", "double", "float")]))
    if not parts:
        raise ValueError("no evaluation is given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lines(scorecard: DataFrame) -> list[str]:
    """The scorecard to read: a line an item under each section. It has a row a measure, whatever the data's size."""
    out: list[str] = []
    shown = None
    items: dict[tuple[str, str], list[str]] = {}
    for r in scorecard.orderBy("section", "item", "measure").collect():
        items.setdefault((r["section"], r["item"]), []).append(f"{r['measure']}={'-' if r['value'] is None else format(r['value'], '.4g')}")
    for (section, item), values in items.items():
        if section != shown:
            out.append(section.upper())
            shown = section
        out.append(f"  {item:<34} {'  '.join(values)}")
    return [*out, "Every proposal awaits a person: no merge and no link is confirmed by itself."]

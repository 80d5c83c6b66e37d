"""Iterative graph operators as DataFrame loops; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.storage import materialise, release


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): every id that an edge names, with the smallest id that it is joined to.

    Alternates large-star (every neighbour above a node goes to the node's least neighbour) and small-star (every neighbour
    below does) until all edges go from a node that has no other to one that has none (stars): a logarithmic number of rounds,
    each linear in the edges. Least neighbours are pre-aggregated and joined back, so a hub's edges are never gathered in one
    task. Nulls and loops join nothing.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    current = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    for _ in range(most_rounds):
        ends = current.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("end")).select("end.*")
        roles = ends.groupBy("id").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        if not roles.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up"))))).first()[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(below, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "components")
        release(current)
        current = after
    else:
        raise RuntimeError("components did not settle")
    least = current.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(least, nodes.id == least.u, "left").select("id", F.coalesce("m", "id").alias("component"))

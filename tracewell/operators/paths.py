"""How two nodes are connected: shortest and simple paths, and their telling in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.storage import materialise

# How each kind of edge is worded; {x} is an attribute of the edge.
PHRASES = {
    "RELATED_TO": "is recorded as {relation} of", "MEMBER_OF": "is a member/officer ({role}) of", "USES_PHONE": "uses phone", "SIM_IN_DEVICE": "which was used in handset",
    "CONTROLS_ACCOUNT": "controls account", "OWNS_VEHICLE": "owns vehicle", "PRESENT_AT": "was observed at", "INVOLVED_IN": "is {role} in", "VEHICLE_INVOLVED": "involved vehicle",
    "OCCURRED_AT": "occurred at", "PART_OF_CASE": "belongs to case",
}


def _both(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def shortest(edges: DataFrame, a, b, max_len: int = 8) -> DataFrame:
    """step, id of a shortest undirected path from a to b (the least by its nodes), or no rows: none within max_len.

    The frontier keeps, for each node reached, the least parent; nodes reached before are left out.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    e = materialise(_both(edges), "links")
    if a == b:
        return e.where(F.col("src") == F.lit(a)).select(F.lit(0).alias("step"), F.col("src").alias("id")).limit(1)
    reached = frontier = spark.createDataFrame([(a, None, 0)], f"id {kind}, parent {kind}, depth int")
    found = False
    for depth in range(1, max_len + 1):
        step = frontier.join(e, frontier.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = materialise(step.join(reached, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        reached = reached.unionByName(frontier)
        if frontier.where(F.col("id") == F.lit(b)).head(1):
            found = True
            break
        if not frontier.head(1):
            break
    if not found:
        return spark.createDataFrame([], f"step int, id {kind}")
    path = reached.where(F.col("id") == F.lit(b)).select("id", "parent", "depth")
    out = path
    for _ in range(depth):
        path = path.select(F.col("parent").alias("_p"), (F.col("depth") - 1).alias("_d")).join(reached, (F.col("_p") == F.col("id")) & (F.col("_d") == F.col("depth"))).select("id", "parent", "depth")
        out = out.unionByName(path)
    return out.select(F.col("depth").alias("step"), "id")


def distances(links: DataFrame, target, most: int) -> DataFrame:
    """id, left: how many steps a node is from target along links (src, dst in both directions), up to most."""
    kind = dict(links.dtypes)["src"]
    reached = frontier = links.sparkSession.createDataFrame([(target, 0)], f"id {kind}, left int")
    for depth in range(1, most + 1):
        step = frontier.join(links, frontier.id == links.dst).select(F.col("src").alias("id")).distinct()
        frontier = materialise(step.join(reached, "id", "left_anti").withColumn("left", F.lit(depth)), "distances")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def all_paths(edges: DataFrame, a, b, cutoff: int = 4, limit: int = 8) -> DataFrame:
    """path, length: the shortest simple paths from a to b of at most cutoff edges, ties by their nodes. None if a is b.

    Distances to b come first; a path only grows to nodes from which b is near enough to be reached within cutoff.
    """
    kind = dict(edges.dtypes)["src"]
    if a == b or cutoff < 1:
        return edges.sparkSession.createDataFrame([], f"path array<{kind}>, length int")
    e = materialise(_both(edges), "links")
    to_go = distances(e, b, cutoff - 1)
    paths = edges.sparkSession.createDataFrame([([a],)], f"path array<{kind}>")
    found = None
    for step in range(1, cutoff + 1):
        near = e.join(to_go.where(F.col("left") <= cutoff - step), e.dst == to_go.id).select("src", "dst")
        grown = paths.join(near, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        grown = materialise(grown, "paths")
        hit = grown.where(F.element_at("path", -1) == F.lit(b))
        found = hit if found is None else found.unionByName(hit)
        paths = grown.where(F.element_at("path", -1) != F.lit(b))
    return found.withColumn("length", F.size("path") - 1).orderBy("length", "path").limit(limit)


def narrated(path: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """narrative of a path (step, id): one phrase a hop, worded in the edge's own direction. edges: src, dst, edge_type and
    attributes; nodes: id, node_type, label. A missing attribute reads as ?, an unknown kind as its name in lower case."""
    hops = path.select(F.col("step"), F.col("id").alias("u")).join(path.select((F.col("step") - 1).alias("step"), F.col("id").alias("v")), "step")
    kinds = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(p)) for k, p in PHRASES.items()], F.lower(F.replace("edge_type", F.lit("_"), F.lit(" "))), F.lit("linked to"))
    text = kinds
    attributes = [c for c in edges.columns if c not in ("src", "dst", "edge_type")]
    for c in attributes:
        text = F.replace(text, F.lit("{" + c + "}"), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "?").otherwise(F.col(c).cast("string")))
    text = F.trim(F.regexp_replace(text, r"\{.*", ""))
    said = edges.select("src", "dst", "edge_type", text.alias("text"))
    ahead = hops.join(said, (F.col("u") == F.col("src")) & (F.col("v") == F.col("dst"))).select("step", "u", "v", F.lit(0).alias("back"), "text", "edge_type")
    behind = hops.join(said, (F.col("v") == F.col("src")) & (F.col("u") == F.col("dst"))).select("step", "u", "v", F.lit(1).alias("back"), "text", "edge_type")
    one = ahead.unionByName(behind).groupBy("step", "u", "v").agg(F.min_by(F.struct("back", "text"), F.struct("back", "edge_type")).alias("t"))
    label = lambda x: nodes.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
    named = hops.join(one, ["step", "u", "v"], "left").join(label("u"), "u", "left").join(label("v"), "v", "left")
    lu, lv = (F.coalesce(f"{x}_label", F.col(x).cast("string")) for x in "uv")
    said_text = F.coalesce("t.text", F.lit("linked to"))
    part = F.when(F.col("t.back") == 1, F.concat_ws(" ", lv, said_text, lu)).otherwise(F.concat_ws(" ", lu, said_text, lv))
    return named.agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", part.alias("p")))), lambda x: x.p), "; "), F.lit(".")).alias("narrative"))


def described(path: DataFrame, nodes: DataFrame) -> DataFrame:
    return path.join(nodes, "id", "left").select("step", "id", F.coalesce("node_type", F.lit("?")).alias("type"), F.coalesce("label", F.col("id").cast("string")).alias("label"))

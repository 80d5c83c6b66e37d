"""Centrality, communities and rankings of an undirected weighted graph: edges a, b, weight with a <> b, one row a pair.

Sums over neighbours are joins and aggregations; PageRank, eigenvector and k-core of up to MAX_ARRAY_EDGES edges have their rounds
on arrays in one task (the eigenvector all but the last), of more in joins, with the same results. Betweenness, articulation points and Louvain need a whole graph in
memory, as arrays, and are refused beyond MAX_ARRAY_EDGES or MAX_LOCAL_EDGES. Communities of larger graphs come from label propagation where the
caller asks for it; no result depends on a graph's size. Loops that don't settle raise.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.conf import KeyPlayer
from tracewell.operators.iterate import components
from tracewell.operators.ordering import all_percent_ranks, numbered, percent_ranks
from tracewell.sources.storage import dealt, materialise, measured, release

CONF = KeyPlayer()
#: Edges of a graph whose copy fits one memory as arrays (16 bytes an edge, with numbers as ids).
MAX_ARRAY_EDGES = 20_000_000
#: The same where nodes take their turns one by one (articulation points, Louvain).
MAX_LOCAL_EDGES = 20_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions."""
    e = edges.where("a <> b")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.round(F.sum(F.col("weight").cast("decimal(20,8)")).cast("double"), 4).alias("weighted_degree"))


def giant(edges: DataFrame) -> DataFrame:
    """Ids of the largest component; of equal ones the one with the least id."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(best), "component", "left_semi").select("id")


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")


def _in_one_task(df: DataFrame, run, schema: str, name: str, unsettled: str | None = None) -> DataFrame:
    """run(the columns of df as arrays) in one task: a dict of arrays, by schema, or None if it did not settle."""
    import pyarrow as pa

    names, out = df.columns, [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        got = run(*[table[c].to_numpy() for c in names])
        if got is None:
            return
        for lo in range(0, len(got[out[0]]), 100_000):
            yield pa.RecordBatch.from_pydict({c: got[c][lo:lo + 100_000] for c in out})

    found = materialise(df.repartition(1).mapInArrow(work, schema), name)
    if unsettled and found.isEmpty() and not df.isEmpty():
        raise RuntimeError(unsettled)
    return found


def _placed(*ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids in order, each of ends as places in ids)."""
    ids = np.unique(np.concatenate([np.unique(x) for x in ends]))
    return ids, [np.searchsorted(ids, x).astype(np.int32) for x in ends]


def pagerank(links: DataFrame, alpha: float = 0.85, iterations: int | None = None, tolerance: float | None = 1e-6, directed: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """id, pagerank of links src, dst, weight (directed) or edges a, b, weight. Rank of dead ends is dealt to all.

    A round is one job: what goes along links that are stored once is added up together with the ranks before it, and the write
    also sees the rank of dead ends and the change. Rounds end when ranks change by less than tolerance a node, and raise if
    they don't; with tolerance None there are just so many. As a round leaves at most alpha of the change before it, on two-sided
    graphs just that, there are as many rounds as this needs where no number is given. A graph without nodes has no rows.
    """
    e = links.select("src", "dst", F.col("weight").cast("double").alias("weight")).where("src is not null and dst is not null") if directed else both_ways(links).withColumn("weight", F.col("weight").cast("double"))
    e = e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("_w"))
    e = materialise(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_w")).alias("share")), "links")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst"))
    ids = materialise((ids if nodes is None else ids.union(nodes.select("id"))).distinct().join(e.select(F.col("src").alias("id")).distinct().withColumn("_out", F.lit(True)), "id", "left"), "nodes")
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    if iterations is None:
        iterations = 100 if tolerance is None else max(100, math.ceil(math.log(n * tolerance / 2) / math.log(alpha)) + 4)
    if iterations and max(n, e.count()) <= MAX_ARRAY_EDGES:
        def rounds(src, dst, share):
            known, (src, dst) = _placed(src, dst)
            order = np.lexsort((src, dst))
            src, dst, share = src[order], dst[order], share[order]
            dead, r = np.bincount(src, share >= 0, n) == 0, np.full(n, 1.0 / n)
            src, dst, share = src[share >= 0], dst[share >= 0], share[share >= 0]
            for _ in range(iterations):
                was, r = r, (1 - alpha + alpha * r[dead].sum()) / n + alpha * np.bincount(dst, r[src] * share, n)
                if tolerance is not None and np.abs(r - was).sum() < n * tolerance:
                    break
            else:
                if tolerance is not None:
                    return None
            return {"id": known, "pagerank": r}

        found = _in_one_task(e.select("src", "dst", "share").unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("share"))), rounds, f"id {dict(ids.dtypes)['id']}, pagerank double", "ranks", f"ranks did not settle in {iterations} rounds")
        release(e)
        release(ids)
        return found
    ranks = ids.select("id", "_out", F.lit(1.0 / n).alias("r"))
    dead = ids.where("_out is null").count() / n
    for _ in range(iterations):
        sent = ranks.join(e, ranks.id == e.src).select(F.col("dst").alias("id"), F.lit(None).cast("boolean").alias("_out"), (F.col("r") * F.col("share")).alias("got"), F.lit(None).cast("double").alias("was"))
        kept = ranks.select("id", "_out", F.lit(0.0).alias("got"), F.col("r").alias("was"))
        new = sent.unionByName(kept).groupBy("id").agg(F.max("_out").alias("_out"), F.sum("got").alias("got"), F.max("was").alias("was"))
        new = new.select("id", "_out", ((1 - alpha + alpha * dead) / n + alpha * F.col("got")).alias("r"), "was")
        after, seen = measured(new, "ranks", dead=F.sum(F.when(F.col("_out").isNull(), F.col("r"))), change=F.sum(F.abs(F.col("r") - F.col("was"))))
        release(ranks)
        ranks, dead = after, seen["dead"] or 0.0
        if tolerance is not None and seen["change"] < n * tolerance:
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"ranks did not settle in {iterations} rounds")
    release(e)
    if iterations:
        release(ids)
    return ranks.select("id", F.col("r").alias("pagerank"))


def eigenvector(edges: DataFrame, iterations: int = 1000, tolerance: float = 1e-8) -> DataFrame:
    """id, eigenvector: the leading eigenvector of the weights, of length 1 (power iteration on A + I, which also settles on two-sided graphs).

    A round is one job, whose write also sees the vector's length; the change is looked at every fourth round. Up to MAX_ARRAY_EDGES
    edges, the vector that rounds on arrays settle on is the start, and few rounds remain. The vector goes to the links, which lie in buckets by src, in a shuffle and never through the driver.
    """
    e = dealt(both_ways(edges).select("src", "dst", F.col("weight").cast("double").alias("weight")), "src", "links")
    before, x = e, e.select(F.col("src").alias("id")).distinct().withColumn("x", F.lit(1.0))
    if e.count() <= MAX_ARRAY_EDGES:
        def rounds(src, dst, weight):
            ids, (src, dst) = _placed(src, dst)
            order = np.lexsort((src, dst))
            src, dst, weight = src[order], dst[order], weight[order]
            x = np.ones(len(ids))
            for k in range(iterations):
                y = np.bincount(dst, x[src] * weight, len(x)) + x
                was, x = x, y / math.sqrt((y * y).sum() or 1.0)
                if k % 4 == 3 and np.abs(x - was).max() < tolerance:
                    break
            return {"id": ids, "x": x}

        before = x = _in_one_task(e.select("src", "dst", "weight"), rounds, f"id {dict(edges.dtypes)['a']}, x double", "start")
    for k in range(iterations):
        sent = x.join(e.hint("merge"), x.id == e.src).select(F.col("dst").alias("id"), (F.col("x") * F.col("weight")).alias("y"), F.lit(None).cast("double").alias("was"))
        y = sent.unionByName(x.select("id", F.col("x").alias("y"), F.col("x").alias("was"))).groupBy("id").agg(F.sum("y").alias("y"), F.max("was").alias("was"))
        after, seen = measured(y, "vector", square=F.sum(F.col("y") * F.col("y")))
        if before is not e:
            release(before)
        norm = math.sqrt(seen["square"] or 1.0)  # no links: no rows either
        before, x = after, after.select("id", (F.col("y") / F.lit(norm)).alias("x"))
        if k % 4 == 3 and (after.agg(F.max(F.abs(F.col("y") / F.lit(norm) - F.col("was")))).first()[0] or 0.0) < tolerance:
            release(e)
            return x.select("id", F.col("x").alias("eigenvector"))
    raise RuntimeError(f"the eigenvector did not settle in {iterations} rounds")


def _peeled(src: np.ndarray, dst: np.ndarray) -> dict:
    """Core numbers: nodes with the fewest neighbours left go first, all at once, and take their links with them."""
    ids, (src, dst) = _placed(src, dst)
    order = np.argsort(src, kind="stable")
    near, degree = dst[order], np.bincount(src, minlength=len(ids))
    starts = np.cumsum(degree) - degree
    left, core, k = degree.copy(), np.full(len(ids), -1, np.int64), 0
    todo = np.arange(len(ids))
    while len(todo):
        k = max(k, left[todo].min())
        gone = todo[left[todo] <= k]
        while len(gone):
            core[gone] = k
            n = degree[gone]
            met = near[np.repeat(starts[gone] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            lost, times = np.unique(met[core[met] < 0], return_counts=True)
            left[lost] -= times
            gone = lost[left[lost] <= k]
        todo = todo[core[todo] < 0]
    return {"id": ids, "kcore": core}


def kcore(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """id, kcore: each node takes the h-index of its neighbours' numbers, from degrees on, until nothing changes.

    Neighbours' numbers are counted by value before they are put in order, so a hub's neighbours never meet one by one.
    A round is one job, whose write also counts the changes.
    """
    from pyspark.sql import Window

    e = materialise(both_ways(edges).select("src", "dst").distinct(), "links")
    if e.count() <= MAX_ARRAY_EDGES:
        found = _in_one_task(e.select("src", "dst"), _peeled, f"id {dict(e.dtypes)['src']}, kcore long", "cores")
        release(e)
        return found
    core = materialise(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "cores")
    down = Window.partitionBy("src").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(most_rounds):
        counts = e.join(core, e.dst == core.id).groupBy("src", "k").agg(F.count("*").alias("n"))
        h = counts.withColumn("upto", F.sum("n").over(down)).groupBy("src").agg(F.max(F.least("k", "upto")).alias("h"))
        after, seen = measured(core.join(h, core.id == h.src).select("id", F.least("k", "h").alias("k"), F.col("k").alias("was")), "cores", changed=F.count_if(F.col("k") != F.col("was")))
        release(core)
        core = after.select("id", "k")
        core._shared_table = after._shared_table
        if not seen["changed"]:
            break
    else:
        raise RuntimeError(f"core numbers did not settle in {most_rounds} rounds")
    release(e)
    return core.select("id", F.col("k").cast("long").alias("kcore"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, clustering: weighted by the geometric mean of a triangle's weights over the greatest weight."""
    top = edges.agg(F.max("weight").alias("top"))
    d = degrees(edges)
    # nodes in the order of their degrees: of a hub's edges few start at it
    corner = lambda c: d.select(F.col("id").alias(c), F.struct("degree", "id").alias(f"_{c}"))
    e = edges.where("a <> b").crossJoin(F.broadcast(top)).join(corner("a"), "a").join(corner("b"), "b")
    e = e.select(F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y"), (F.col("weight") / F.col("top")).alias("w"))
    # a triangle is found once, from its least corner
    xy, xz, yz = e.select("x", "y", F.col("w").alias("w1")), e.select("x", F.col("y").alias("z"), F.col("w").alias("w2")), e.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("w").alias("w3"))
    t = xy.join(xz, "x").where("y < z").join(yz, ["y", "z"]).withColumn("g", F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")))
    per = t.select(F.explode(F.array("x.id", "y.id", "z.id")).alias("id"), "g").groupBy("id").agg(F.sum("g").alias("g"))
    return d.join(per, "id", "left").select("id", F.when(F.col("degree") < 2, 0.0).otherwise(F.round(2 * F.coalesce("g", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1)), 6)).alias("clustering"))


def _checked(edges: DataFrame, most: int) -> DataFrame:
    """a, b, weight of the edges, with their number checked first."""
    e = materialise(edges.select("a", "b", F.col("weight").cast("double").alias("weight")).where("a <> b"), "edges")
    if e.count() > most:
        raise ValueError(f"more than {most} edges: too many for a graph in one memory")
    return e


def _compressed(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple:
    """(ids in order, starts, neighbours, their weights): the neighbours of node i, by their places in ids, are those from starts[i] to starts[i + 1]."""
    ids, (a, b) = _placed(a, b)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((dst, src))
    starts = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
    return ids, starts, dst[order], None if weight is None else np.concatenate([weight, weight])[order]


def _twins(starts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The first node that has the same neighbours as each node: found by sums of random marks, then held against the neighbours themselves."""
    degree = np.diff(starts)
    marks = np.random.default_rng(0).integers(0, 1 << 62, (2, len(degree)))
    sums = [np.add.reduceat(m[near], starts[:-1]) for m in marks]
    order = np.lexsort((sums[1], sums[0], degree))
    head = np.ones(len(order), bool)
    head[1:] = np.any([np.diff(x[order]) != 0 for x in (degree, *sums)], axis=0)
    first = np.empty(len(order), np.int64)
    first[order] = order[head][np.cumsum(head) - 1]
    src = np.repeat(np.arange(len(degree), dtype=np.int32), degree)
    unlike = np.unique(src[near != near[starts[first[src]] - starts[src] + np.arange(len(near))]])
    first[unlike] = unlike
    return first


def betweenness(edges: DataFrame) -> DataFrame:
    """id, betweenness: shares of shortest paths (unweighted) through each node, normalised.

    Nodes with the same neighbours are one class: they see the same paths, so one of them is a source for all, and a path to one
    stands for those to the others. Classes are dealt to tasks; each counts paths from its sources over the shared adjacency, in
    arrays. Every node counts as a source, whatever the graph's size.
    """
    spark = edges.sparkSession
    e = _checked(edges, MAX_ARRAY_EDGES)
    rows = e.select("a", "b").toArrow()
    ids, starts, near, _ = _compressed(*(rows[c].to_numpy() for c in "ab"))
    release(e)
    n, kind = len(ids), dict(edges.dtypes)["a"]
    if n < 3:
        return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.lit(0.0).alias("betweenness"))
    first, degree = _twins(starts, near), np.diff(starts)
    leads = np.flatnonzero(first == np.arange(n))
    classes, size = np.searchsorted(leads, first).astype(np.int32), np.bincount(first, minlength=n)[leads].astype(float)
    src = np.repeat(np.arange(n, dtype=np.int32), degree)
    kept = (first[src] == src) & (first[near] == near)  # a link between the first of a class and the first of another is their only one
    starts, near = np.concatenate([[0], np.cumsum(np.bincount(classes[src[kept]], minlength=len(leads)))]), classes[near[kept]]
    shared = spark.sparkContext.broadcast((ids, classes, starts, near, size, degree[leads]))

    def loads(starts: np.ndarray, near: np.ndarray, size: np.ndarray, s: int) -> np.ndarray:
        """What a node of each class carries of the shortest paths from one of class s to all other classes: a level at a time, out and back."""
        depth = np.full(len(size), -1, np.int32)
        paths, load = np.zeros(len(depth)), np.zeros(len(depth))
        depth[s], paths[s], front, levels = 0, 1.0 / size[s], np.array([s]), []
        while len(front):
            n = starts[front + 1] - starts[front]
            src, to = np.repeat(front, n), near[np.repeat(starts[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            fresh = depth[to] < 0
            src, to = src[fresh], to[fresh]
            levels.append((src, to))
            step = np.bincount(to, paths[src] * size[src], len(depth)) if len(to) else np.zeros(len(depth))
            front = np.flatnonzero(step)
            depth[front], paths[front] = len(levels), step[front]
        for src, to in reversed(levels):
            if len(to):
                load += np.bincount(src, paths[src] / paths[to] * (1 + load[to]) * size[to], len(depth))
        load[s] = 0.0
        return load

    def work(batches):
        ids, classes, starts, near, size, degree = shared.value
        total, every = np.zeros(len(size)), False
        for batch in batches:
            for s in batch["id"]:
                every |= s == 0
                total += loads(starts, near, size, s) * size[s]
                # two of a class have a path through each neighbour
                total[near[starts[s]:starts[s + 1]]] += size[s] * (size[s] - 1) / degree[s]
        load = total[classes]
        hit = (load > 0) | every  # one task has the nodes on no path too
        yield pd.DataFrame({"id": ids[hit], "load": load[hit]})

    parts = min(spark.sparkContext.defaultParallelism, len(leads))
    loads_of = spark.range(len(leads)).repartition(parts, F.xxhash64("id")).mapInPandas(work, f"id {kind}, load double")
    return loads_of.groupBy("id").agg(F.round(F.sum("load") / ((n - 1) * (n - 2)), 9).alias("betweenness"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """Ids whose removal parts their component, by depth-first low links."""
    kind = dict(edges.dtypes)["a"]
    e = _checked(edges, MAX_LOCAL_EDGES)
    found = _in_one_task(e.select("a", "b"), _cuts, f"id {kind}", "cuts")
    release(e)
    return found


def _cuts(a: np.ndarray, b: np.ndarray) -> dict:
    ids, starts, near, _ = _compressed(a, b)
    n = len(ids)
    at, end, near = starts[:-1].tolist(), starts[1:].tolist(), array("i", near.tobytes())
    seen, low, cut, count = array("i", [-1]) * n, array("i", [0]) * n, np.zeros(n, bool), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = count
        count += 1
        stack, children = [(root, -1)], 0
        while stack:
            v, parent = stack[-1]
            if at[v] == end[v]:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if u != root and low[v] >= seen[u]:
                        cut[u] = True
                continue
            w = near[at[v]]
            at[v] += 1
            if seen[w] < 0:
                seen[w] = low[w] = count
                count += 1
                children += v == root
                stack.append((w, v))
            elif w != parent:
                low[v] = min(low[v], seen[w])
        cut[root] = children > 1
    return {"id": ids[cut]}


def _louvain(a: np.ndarray, b: np.ndarray, weight: np.ndarray, resolution: float) -> dict:
    """Greedy modularity: nodes move to the neighbouring community with the largest gain, communities become nodes, and again.

    Nodes take their turns in the order of their least edges, and of equal gains the least community by its name as text counts.
    The links of a level are arrays; one node's are Python objects at a time.
    """
    ids, starts, near, weight = _compressed(a, b, weight)
    n = len(ids)
    name = np.argsort(np.argsort(np.array([str(v) for v in ids]), kind="stable")).tolist()
    # a node's turn is where it is first named by edges in order: with its first neighbour, if that is less
    first = near[starts[:-1]]
    own = np.arange(n)
    turns = np.lexsort((own > first, np.maximum(own, first), np.minimum(own, first)))
    home, total, alive = own.copy(), None, turns
    while True:
        comm, moved_any = array("i", range(n)), False
        turn = {v: (int(starts[v]), int(starts[v + 1])) for v in alive.tolist()}
        strength = dict.fromkeys(turn, 0.0)
        for v, (lo, hi) in turn.items():
            strength[v] = sum(weight[lo:hi].tolist())
        total = total or sum(strength.values())
        inside_of = dict(strength)
        while True:
            moved = False
            for v, (lo, hi) in turn.items():
                links: dict = {}
                for w, x in zip(near[lo:hi].tolist(), weight[lo:hi].tolist(), strict=True):
                    if w != v:
                        c = comm[w]
                        links[c] = links.get(c, 0.0) + x
                own_c, mine = comm[v], strength[v]
                inside_of[own_c] -= mine
                pull = resolution * mine
                best, gain = own_c, links.get(own_c, 0.0) - pull * inside_of[own_c] / total
                for c in sorted(links, key=name.__getitem__):
                    g = links[c] - pull * inside_of[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                inside_of[best] += mine
                if best != own_c:
                    comm[v], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            return {"id": ids, "home": home}
        to = np.array(comm, np.int32)
        home = to[home]
        alive, starts, near, weight = _merged(alive, starts, near, weight, to)


def _merged(alive: np.ndarray, starts: np.ndarray, near: np.ndarray, weight: np.ndarray, to: np.ndarray) -> tuple:
    """The level above: communities in the order in which their first member has its turn, links in the order in which they are met."""
    n, size = len(to), np.diff(starts)[alive]
    at = np.repeat(starts[alive] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    pair = to[np.repeat(alive, size)].astype(np.int64) * n + to[near[at]]
    keys, first, places = np.unique(pair, return_index=True, return_inverse=True)
    sums = np.bincount(places, weight[at], len(keys))
    order = np.lexsort((first, keys // n))
    src, dst = keys[order] // n, keys[order] % n
    leads, turn = np.unique(to[alive], return_index=True)
    return leads[np.argsort(turn)], np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst.astype(np.int32), sums[order]


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20, method: str = "louvain") -> DataFrame:
    """id, community: numbered from 0, the largest first. method: louvain (in one memory, refused beyond MAX_LOCAL_EDGES) or label_propagation."""
    if method not in ("louvain", "label_propagation"):
        raise ValueError(method)
    if method == "louvain":
        e, kind = _checked(edges, MAX_LOCAL_EDGES), dict(edges.dtypes)["a"]

        def run(a, b, weight):
            found = _louvain(a, b, weight, resolution)
            _, first, group, size = np.unique(found["home"], return_index=True, return_inverse=True, return_counts=True)
            place = np.empty(len(size), np.int64)
            place[np.lexsort((first, -size))] = np.arange(len(size))
            return {"id": found["id"], "community": place[group]}

        found = _in_one_task(e, run, f"id {kind}, community long", "communities")
        release(e)
        return found
    return _numbered_communities(label_propagation(edges, rounds))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, label, settled: each node takes the heaviest label around it (its own counts a little; the least of equal ones), for at most so many rounds.

    Labels may swing for ever; settled is false for the nodes whose label changed in the last round.
    """
    e = materialise(both_ways(edges), "links")
    labels = e.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit(False).alias("settled"))
    for _ in range(rounds):
        own = labels.select("id", "label")
        votes = e.join(own, e.dst == own.id).select(F.col("src").alias("id"), "label", "weight")
        votes = votes.unionByName(own.withColumn("weight", F.lit(1e-6))).groupBy("id", "label").agg(F.sum("weight").alias("w"))
        taken = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label"))
        taken = taken.join(own.withColumnRenamed("label", "_before"), "id").select("id", "label", (F.col("label") == F.col("_before")).alias("settled"))
        former, (labels, seen) = labels, measured(taken, "labels", moved=F.count_if(~F.col("settled")))
        release(former)
        if not seen["moved"]:
            break
    return labels


def _numbered_communities(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return labels.join(numbered(sizes, "n", "first", "_i").select("label", (F.col("_i") - 1).alias("community")), "label").select("id", "community")


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """modularity: the sum over communities of inner weight / m - (strength / 2m)^2."""
    c = lambda x: community.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    e = edges.where("a <> b").join(c("a"), "a").join(c("b"), "b").withColumn("weight", F.col("weight").cast("double"))
    m = e.agg(F.sum("weight").alias("m"))
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("l"))
    strength = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    return strength.join(inner, "c", "left").crossJoin(F.broadcast(m)).agg(F.round(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def cross_community_reach(edges: DataFrame, community: DataFrame) -> DataFrame:
    """id, reach: communities other than its own among a node's neighbours, against the greatest number of any node."""
    own, other = community.select(F.col("id").alias("src"), F.col("community").alias("own")), community.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    n = both_ways(edges).join(own, "src", "left").join(other, "dst", "left").groupBy(F.col("src").alias("id")).agg(F.count_distinct(F.when(F.col("other").isNotNull() & ~F.col("other").eqNullSafe(F.col("own")), F.col("other"))).alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select("id", F.round(F.coalesce(F.try_divide("n", "top"), F.lit(0.0)), 6).alias("reach"))


def broker_scores(edges: DataFrame, community: DataFrame, between: DataFrame) -> DataFrame:
    """id, broker_score: mostly reach, betweenness breaks ties."""
    r = percent_ranks(cross_community_reach(edges, community), "reach", "r_reach")
    b = percent_ranks(between, "betweenness", "r_btw")
    return r.join(b, "id", "left").select("id", F.round(0.85 * F.col("r_reach") + 0.15 * F.coalesce("r_btw", F.lit(0.0)), 4).alias("broker_score"))


def key_players(edges: DataFrame, metrics: DataFrame, community: DataFrame, cut: DataFrame, command: DataFrame | None = None, broker: DataFrame | None = None, conf: KeyPlayer = CONF) -> DataFrame:
    """Ranked nodes. metrics: id, degree, betweenness, eigenvector, pagerank, kcore (null outside the giant); cut: articulation ids;
    command: id, command_score, direct_subordinates, subordinate_span, hierarchy_depth; broker: id, broker_score."""
    df = metrics.join(cross_community_reach(edges, community), "id", "left")
    df = all_percent_ranks(df, ["betweenness", "eigenvector", "pagerank", "degree", "kcore", "reach"])
    df = df.na.fill(0.0, [f"r_{c}" for c in ("betweenness", "eigenvector", "pagerank", "degree", "kcore", "reach")])
    kind = dict(df.dtypes)["id"]
    if command is None:
        command = df.sparkSession.createDataFrame([], f"id {kind}, command_score double, direct_subordinates long, subordinate_span long, hierarchy_depth long")
    df = df.join(command.select("id", "command_score", "direct_subordinates", "subordinate_span", "hierarchy_depth"), "id", "left")
    df = df.na.fill(0.0, ["command_score", "betweenness", "eigenvector", "pagerank", "reach"]).na.fill(0, ["direct_subordinates", "subordinate_span", "hierarchy_depth", "kcore"])
    structural = sum(getattr(conf, w) * F.col(f"r_{c}") for w, c in (("betweenness", "betweenness"), ("eigenvector", "eigenvector"), ("pagerank", "pagerank"), ("degree", "degree"), ("kcore", "kcore"), ("reach", "reach")))
    fallback = 0.45 * F.col("r_betweenness") + 0.40 * F.col("r_reach") + 0.15 * (1 - F.col("r_degree"))
    df = df.join(broker.select("id", F.col("broker_score").alias("_b")), "id", "left") if broker is not None else df.withColumn("_b", F.lit(None).cast("double"))
    df = df.join(cut.select("id", F.lit(1).alias("_cut")), "id", "left").join(community, "id", "left")
    df = df.withColumns({
        "structural_score": F.round(structural, 4), "influence_score": F.round((1 - conf.command) * structural + conf.command * F.col("command_score"), 4),
        "broker_score": F.round(F.coalesce("_b", fallback), 4), "is_articulation_point": F.coalesce("_cut", F.lit(0)), "community": F.coalesce("community", F.lit(-1)).cast("long"),
    })
    df = materialise(df.withColumn("inferred_role", inferred_role()), "players")
    return numbered(df, "influence_score", "id", "rank").select(
        "id", "rank", "influence_score", "structural_score", F.round("command_score", 4).alias("command_score"), "broker_score", "direct_subordinates", "subordinate_span", "hierarchy_depth",
        F.round("betweenness", 6).alias("betweenness"), F.round("eigenvector", 6).alias("eigenvector"), F.round("pagerank", 6).alias("pagerank"), "degree", "kcore", F.col("reach").alias("communities_touched"),
        "is_articulation_point", "community", "inferred_role",
    )


def inferred_role() -> Column:
    """A role from position alone: the first rule that holds."""
    # Thresholds and names of the roles.
    direct, span, d, b = F.col("direct_subordinates"), F.col("subordinate_span"), F.col("r_degree"), F.col("r_betweenness")
    return (
        F.when((direct >= 2) & (span >= F.greatest(F.lit(8), 3 * direct)), "APEX / INSULATED CONTROLLER").when(direct >= 8, "CELL COMMANDER").when((span >= 4) & (d < 0.85), "CELL LEADER")
        .when((b > 0.97) & (F.col("reach") > 0.25), "BROKER / CUT-VERTEX").when((b > 0.92) & (d < 0.80), "INSULATED CONTROLLER").when(d > 0.95, "OPERATIONAL HUB")
        .when((F.col("is_articulation_point") == 1) & (b > 0.75), "SINGLE POINT OF FAILURE").when((d < 0.30) & (b < 0.30), "PERIPHERAL").otherwise("CORE MEMBER")
    )


def ranked_by(players: DataFrame, kind: str = "influence", top_n: int | None = None) -> DataFrame:
    """Players by one of four scores, with their place in it."""
    if kind not in ("influence", "command", "broker", "structural"):
        raise ValueError(kind)
    out = numbered(players, f"{kind}_score", "id", f"{kind}_rank")
    return out.where(F.col(f"{kind}_rank") <= top_n) if top_n else out


def disruption(edges: DataFrame, ranked: DataFrame, budgets: tuple[int, ...] = (1, 5, 10, 20, 40)) -> DataFrame:
    """budget, strategy, largest_component, largest_component_pct, n_components after removing the first ranked (id, rank) or, as a
    baseline, the nodes of highest degree. All scenarios are one graph, whose nodes carry their scenario."""
    base = giant(edges).count()
    deg = numbered(degrees(edges), "degree", "id", "rank")
    plans = ranked.select("id", "rank", F.lit("key_player_targeting").alias("strategy")).unionByName(deg.select("id", "rank", F.lit("degree_baseline").alias("strategy")))
    cases = edges.sparkSession.createDataFrame([(b, s) for b in budgets for s in ("key_player_targeting", "degree_baseline")], "budget int, strategy string")
    gone = plans.join(F.broadcast(cases), "strategy").where("rank <= budget").select("budget", "strategy", "id")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().crossJoin(F.broadcast(cases)).join(gone, ["budget", "strategy", "id"], "left_anti")
    key = F.xxhash64("budget", "strategy", "id")
    live = nodes.select("budget", "strategy", "id", key.alias("k"))
    e = edges.select("a", "b").crossJoin(F.broadcast(cases))
    e = e.join(live.select("budget", "strategy", F.col("id").alias("a"), F.col("k").alias("ka")), ["budget", "strategy", "a"]).join(live.select("budget", "strategy", F.col("id").alias("b"), F.col("k").alias("kb")), ["budget", "strategy", "b"])
    c = components(e.select("ka", "kb"), "ka", "kb")
    sizes = live.join(c, live.k == c.id, "left").groupBy("budget", "strategy", F.coalesce("component", "k").alias("c")).agg(F.count("*").alias("n"))
    out = sizes.groupBy("budget", "strategy").agg(F.max("n").alias("largest_component"), F.count("*").alias("n_components"))
    return cases.join(out, ["budget", "strategy"], "left").na.fill(0).select("budget", "strategy", "largest_component", F.round(100 * F.col("largest_component") / F.lit(max(base, 1)), 2).alias("largest_component_pct"), "n_components")


def community_profile(community: DataFrame, persons: DataFrame, incidents: DataFrame, between: DataFrame) -> DataFrame:
    """What members do. persons: id, role, syndicate, state, risk; incidents: id, crime; between: id, betweenness."""
    from pyspark.sql import Window

    m = community.join(persons, "id", "left")

    def most(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
        n = df.groupBy("community", F.coalesce(F.col(value).cast("string"), F.lit("-")).alias("v")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("community").orderBy(F.desc("n"), "v")
        return n.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "v", "n"))), lambda x: x.v), "|").alias(out), F.max("n").alias(f"{out}_n"))

    found = community.join(persons.select("id"), "id", "left_semi")
    member = found.join(persons, "id")
    crimes = most(community.join(incidents, "id"), "crime", 4, "top_crimes").drop("top_crimes_n")
    group = most(member, "syndicate", 1, "dominant_recorded_syndicate")
    w = Window.partitionBy("community").orderBy(F.desc("betweenness"), "id")
    lead = community.join(between, "id", "left").na.fill(0.0, ["betweenness"]).withColumn("i", F.row_number().over(w)).where("i <= 5").groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "id"))), lambda x: x.id.cast("string")), "|").alias("likely_leaders"))
    out = m.groupBy("community").agg(F.count("*").alias("size"), F.coalesce(F.round(F.avg("risk"), 1), F.lit(0.0)).alias("avg_risk"))
    for part in (crimes, most(member, "state", 3, "top_states").drop("top_states_n"), most(member, "role", 5, "role_mix").drop("role_mix_n"), group, lead):
        out = out.join(part, "community", "left")
    return out.withColumn("purity", F.round(F.coalesce("dominant_recorded_syndicate_n", F.lit(0)) / F.col("size"), 3)).drop("dominant_recorded_syndicate_n")

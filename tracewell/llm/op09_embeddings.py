"""Embedding near-dedup with randomised-rotation binary codes.

A vector is made a unit vector, rotated at random and stored as the signs of its coordinates (the code) with the correction
factor f = <code, vector>, and as a query of one byte a coordinate with the length of what rounding lost. For another unit
vector q, <code, q> / f estimates their cosine without bias; its error is sqrt(1 - cos^2) * sqrt((1 - f^2) / f^2 / (dim - 1))
times a number that is as good as normal, and rounding adds at most the lost length / f. A pair whose estimate plus SURE such
errors (at the threshold's cosine) and that length stays under the threshold is done with; every other one is computed again
in double precision.

Equal vectors are one class with a count and a number of its own: ids may repeat or be null. Each class goes to the PROBES
nearest of a sample of centres that grows with the table and has two levels, after the sample's mean is taken out, so that a
direction which all vectors share doesn't draw them into few cells; of centres that would link, one stays. Two linked vectors
are compared in the first cell that both have. A cell with many vectors is dealt out to blocks, and each pair of blocks is a task, so no cell is
gathered in one. Codes and queries are what is dealt out; vectors follow only for those that a code didn't rule out. Tasks
give counts and a spanning forest of their links, never pairs.

With exact=True there is one cell, so every pair's code is looked at; otherwise the cells are an index: two vectors that
share none of their cells are not compared.

Results: vectors that are null, zero, hold null or non-finite components or have another length than most link with
nothing; a table of few vectors has as few cells as every vector goes to, so all pairs are compared; repeated rows are copies
that link with each other; rows that share an id are vectors of their own; component_id is the least id of a component that
isn't null, and null if all are; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _shared
from tracewell.operators.iterate import components

THRESHOLD, SURE, SEED = 0.9, 6.0, 11
#: Vectors that a cell is to hold; bytes of centres at most (a sample bounded by them is collected and sent to the workers);
#: centres of a group; groups and cells that a vector looks at.
CELL, CENTRE_BYTES, GROUP, GROUP_PROBES, PROBES = 400, 64 << 20, 256, 32, 10
#: Rows of a block; a pair of blocks is one task. Pairs of rows that are computed again at once.
BLOCK, PAIRS = 2048, 20_000


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits, packed, and correction factors of rotated unit vectors."""
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(1) / math.sqrt(rotated.shape[1])


def rounded(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a coordinate, the step that it counts, and the length of what rounding lost."""
    step = np.abs(rotated).max(1) / 127
    small = np.rint(rotated / step[:, None]).astype(np.int8)
    return small, step, np.linalg.norm(rotated - small * step[:, None], axis=1)


def candidates(bits: np.ndarray, factors: np.ndarray, small: np.ndarray, steps: np.ndarray, lost: np.ndarray, threshold: float = THRESHOLD, sure: float = SURE) -> np.ndarray:
    """(n, m) booleans: the pairs of codes and rounded queries whose cosine may reach the threshold."""
    dim = small.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = signs @ small.T.astype(np.float32)
    estimate *= (steps / math.sqrt(dim)).astype(np.float32)
    estimate += lost.astype(np.float32)
    error = math.sqrt(1 - threshold**2) * np.sqrt((1 - factors**2).clip(0) / factors**2 / max(dim - 1, 1))
    return estimate >= ((threshold - sure * error - 1e-5) * factors).astype(np.float32)[:, None]


class Centres:
    """Two levels: groups by their first members, and each group's centres, none of which link. All without the sample's mean."""

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD):
        self.mean = sample.mean(0)
        whole, sample = sample.astype(np.float32), self.placed(sample)
        n = max(1, len(sample) // GROUP)
        self.tops = sample[:n]
        nearest = np.concatenate([(sample[i:i + 4096] @ self.tops.T).argmax(1) for i in range(0, len(sample), 4096)])
        self.groups, self.first = [], []
        count = 0
        for t in range(n):
            own, as_given = sample[nearest == t], whole[nearest == t]
            free, kept = np.ones(len(own), bool), []
            while free.any():
                i = int(free.argmax())
                kept.append(i)
                free &= as_given @ as_given[i] < threshold
                free[i] = False
            self.groups.append(own[kept])
            self.first.append(count)
            count += len(kept)
        self.count = count

    def placed(self, u: np.ndarray) -> np.ndarray:
        """Directions from the mean; the mean itself has none and stays zero."""
        away = u - self.mean
        return (away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def nearest(self, u: np.ndarray) -> list[list[int]]:
        """For each unit vector the numbers of its PROBES nearest centres, in order, among the GROUP_PROBES nearest groups."""
        u = self.placed(u)
        groups = min(GROUP_PROBES, len(self.tops))
        near = np.argpartition(-(u @ self.tops.T), groups - 1, axis=1)[:, :groups]
        score = np.full((len(u), groups * PROBES), -2, np.float32)
        cell = np.full(score.shape, -1, np.int32)
        for t in np.unique(near):
            row, slot = np.nonzero(near == t)
            own = u[row] @ self.groups[t].T
            k = min(PROBES, own.shape[1])
            best = np.argpartition(-own, k - 1, axis=1)[:, :k]
            at = slot[:, None] * PROBES + np.arange(k)
            score[row[:, None], at] = np.take_along_axis(own, best, 1)
            cell[row[:, None], at] = best + self.first[t]
        k = min(PROBES, score.shape[1])
        best = np.take_along_axis(cell, np.argpartition(-score, k - 1, axis=1)[:, :k], 1)
        best.sort(axis=1)
        return [x[x >= 0].tolist() for x in best]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0..n-1, the least number that pairs (a, b) join each to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


DEALT = "cid long, weight long, cells array<int>, code binary, factor double, small binary, step double, lost double, cell int, x int, y int, side int"
FOUND = "cid long, root long, links long"


def _may_link(table: pa.Table, threshold: float) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The order in which side 0 comes first, and pairs of rows, in that order, of two blocks of a cell or of one.

    They are those that the codes don't rule out, where the cell is the first that both have.
    """
    side = table["side"].to_numpy()
    order = np.argsort(side, kind="stable")
    cell = table["cell"][0].as_py()
    had = table["cells"].to_pylist()
    cells = np.full((len(order), PROBES), -1, np.int32)
    for i, k in enumerate(order):  # earlier cells only
        early = [c for c in had[k] if c < cell]
        cells[i, :len(early)] = early
    many = len(order)
    bits = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(many, -1)[order]
    small = np.frombuffer(b"".join(table["small"].to_pylist()), np.int8).reshape(many, -1)[order]
    factors, steps, lost = (table[c].to_numpy()[order] for c in ("factor", "step", "lost"))
    n = int((side == 0).sum())
    same = n == many
    rest = np.arange(many) if same else np.arange(n, many)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, n, 256):
            part = slice(s, min(s + 256, n))
            i, j = np.nonzero(candidates(bits[part], factors[part], small[rest], steps[rest], lost[rest], threshold))
            i, j = i + s, rest[j]
            if same:
                i, j = i[i < j], j[i < j]
            for p in range(0, len(i), PAIRS):
                a, b = i[p:p + PAIRS], j[p:p + PAIRS]
                early = np.zeros(len(a), bool)
                for k in range(PROBES):
                    own = cells[a, k]
                    early |= (own >= 0) & (cells[b] == own[:, None]).any(1)
                yield a[~early], b[~early]

    return order, pairs()


def _survivors(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        """The rows that have a pair which the codes don't rule out."""
        order, pairs = _may_link(table, threshold)
        live = np.zeros(len(order), bool)
        for a, b in pairs:
            live[a] = live[b] = True
        return table.take(pa.array(np.sort(order[live])))

    return work


def _confirm(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        """Links between the rows, in double precision: how many each has, and the least row that they join it to."""
        order, pairs = _may_link(table, threshold)
        cids, weight = table["cid"].to_numpy()[order], table["weight"].to_numpy()[order]
        u = units(np.frombuffer(b"".join(table["vector"].to_pylist()), "<f8").reshape(len(order), -1)[order])
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in pairs:
            hit = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
            rows.append(a[hit])
            cols.append(b[hit])
        a, b = np.concatenate(rows), np.concatenate(cols)
        links = np.bincount(a, weight[b], len(cids)) + np.bincount(b, weight[a], len(cids))
        root = _roots(len(cids), a, b)
        keep = links > 0
        return pa.table({"cid": pa.array(cids[keep]), "root": pa.array(cids[root][keep]), "links": pa.array(links[keep].astype(np.int64))})

    return work


def dedup(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """vec_id, n_links long, component_id long, kept boolean: one row for each row of df."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    finite = F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = rows.withColumn("_v", F.when(finite, F.col("_v")))
    lengths = rows.where("_v is not null").groupBy(F.size("_v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return rows.select(F.col("_id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    dim = lengths[0]["dim"]

    def packed():
        import xxhash

        def f(vectors):
            raw = [None if v is None or len(v) != dim else (np.array(v) + 0.0).tobytes() for v in vectors.to_pylist()]  # -0 is 0
            return [pa.array([r and xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())]

        return f

    keyed = _shared.materialise(_shared.map_columns(rows, ["_v"], [T.StructField("key", T.BinaryType()), T.StructField("vector", T.BinaryType())], packed, drop=("_v",)), "keyed")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = _shared.materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    total = classes.count()

    wanted = 1 if exact else min(max(total // cell, 1), CENTRE_BYTES // 4 // dim)
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(total)) < wanted).select("key", "vector").limit(2 * wanted).collect() if wanted > 1 else []
    drawn = [r.vector for r in sorted(drawn, key=lambda r: bytes(r.key))]
    centres = Centres(units(np.frombuffer(b"".join(drawn), "<f8").reshape(-1, dim)), threshold) if drawn else None
    shared, turn = spark.sparkContext.broadcast(centres), rotation(dim)

    def placing():
        own = shared.value

        def f(vectors):
            u = units(np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(-1, dim))
            rotated = u @ turn
            bits, factors = codes(rotated)
            small, steps, lost = rounded(rotated)
            return [
                pa.array(own.nearest(u) if own else [[0]] * len(u), pa.list_(pa.int32())), pa.array(map(bytes, bits), pa.binary()), pa.array(factors),
                pa.array([x.tobytes() for x in small], pa.binary()), pa.array(steps), pa.array(lost),
            ]

        return f

    stored = T.StructType.fromDDL("cells array<int>, code binary, factor double, small binary, step double, lost double").fields
    placed = _shared.materialise(_shared.map_columns(classes.select("cid", "weight", "vector"), ["vector"], stored, placing, drop=("vector",)), "placed")
    own = placed.withColumn("cell", F.explode("cells"))
    many = own.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("many"))  # a row a centre
    own = own.join(F.broadcast(many), "cell").withColumn("block", F.pmod(F.xxhash64("cid", "cell"), F.col("many")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("many") - 1).cast("int")))).select(
        "cid", "weight", "cells", "code", "factor", "small", "step", "lost", "cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    live = _shared.materialise(dealt.groupBy("cell", "x", "y").applyInArrow(_survivors(threshold), DEALT), "survivors")
    found = live.join(classes.select("cid", "vector"), "cid").groupBy("cell", "x", "y").applyInArrow(_confirm(threshold), FOUND)
    found = _shared.materialise(found, "found")
    _shared.release(live)
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = classes.select("cid", "key", "least", "weight").join(counts, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    per_class = _shared.materialise(per_class.select("key", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "classes")
    least = per_class.groupBy("component").agg(F.min("least").alias("component_id"))
    known = per_class.drop("least").join(least, "component")
    component = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return keyed.select("_id", "key").join(known, "key", "left").select(
        F.col("_id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept")
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(_shared.table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embeddings": op9_embeddings}
ORACLES = {
    "op9_embeddings": """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), reach(id, other) as (
  select a, b from links union select r.id, l.b from reach r join links l on r.other = l.a
), least as (select id, min(other) as other from reach group by id), counted as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(other, vec_id)) as component_id, vec_id <= coalesce(other, vec_id) as kept
from v left join least on id = vec_id left join counted on a = vec_id"""
}

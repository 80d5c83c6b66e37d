"""MinHash near-dedup with an LSH forest.

A document is the set of its distinct word shingles. Documents with equal sets form a class; one of each class goes on, under
a number of its own: ids may repeat or be null. TREES signatures of DEPTH minima each are the trees of the forest. Documents
that share a prefix in a tree are neighbours there: a region is those with one first minimum, and where more than RUN of
them are, adaptively, those with a longer common prefix (LEVELS). More than RUN documents with one whole prefix are dealt to
a ring of blocks, each compared within itself and with the next one; once components are known, blocks of the most frequent one
meet all blocks of other components, and these each other, so that no two components of a prefix pass each other. Regions follow from the documents alone, never from
partitions. Inside a region all documents are compared by the low bits of their minima, and each proposes its nearest
neighbours and the most central one; proposals, not pairs, leave the task, so their number is linear in the documents.
Proposals are confirmed on full sets in rounds, the nearest first, and a proposal whose two ends are joined already is
skipped; the rounds end when no proposal is left. Then the documents that proposed anything are dealt out again, and each
proposes its nearest neighbours outside its own component. A pair that is left out by that has two documents with more such
neighbours than they proposed: these are dealt out once more with their full sets, and a region confirms all their pairs of
different components where they lie. Only links that join two components leave the task, fewer than it has documents.

The search is approximate where it says neighbours: two linked documents have to share a region in one of the trees and to
differ in no more low bits than SLACK allows. Every link that is used is confirmed exactly.

Results: documents without words link with nothing; with fewer words than a shingle's, the whole sequence is one shingle;
equal rows are in one class; rows that share an id or have none are documents of their own; component_id is the least id of
a component that isn't null, and null if all are; an empty table gives no rows. doc_id must be a column of integers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _shared
from tracewell.llm.op06_substring import U, _word_hash, mixed
from tracewell.operators.iterate import components

#: Words of a shingle, and the similarity in hundredths from which documents are linked.
SHINGLE, PERCENT = 5, 80
TREES, DEPTH = 12, 8
#: Documents compared at once in a region; larger ones are parted by a deeper prefix, of so many minima.
RUN, LEVELS = 2048, (1, 2, 4, 8)
#: Nearest neighbours that a document proposes in a region, besides the central one.
NEAREST = 8
#: Standard deviations of the estimate below the threshold from which a pair is still proposed.
SLACK = 3.7
#: Proposals of each document that a round confirms: more and more, at last all.
ROUNDS = (1, 6, 1 << 30)
#: Neighbours outside its own component that a document then proposes in a region; the pairs beyond are confirmed in the region.
OUTSIDE = 8
#: Sets that a region confirms against one at once.
AT_ONCE = 256
#: Bytes of sets that a worker keeps while it confirms pairs: only speed depends on them.
KEPT_BYTES = 8 << 20
LAST_ID = (1 << 63) - 1

_RNG = np.random.default_rng(20_240_607)
_FACTORS = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << U(1) | U(1)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the shingles of a text's words (A-Z lower-cased)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    if len(h) < n:
        out = U(len(h))
        for x in h:
            out = out * U(0x9E3779B97F4A7C15) + x
        return mixed(np.array([out]))
    count = len(h) - n + 1
    out = h[:count].copy()
    for j in range(1, n):
        out *= U(0x9E3779B97F4A7C15)
        out += h[j:j + count]
    return np.unique(mixed(out))


def signatures(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """id, hash (of the text), n_shingles, set_key binary (16 bytes), minima binary (TREES * DEPTH big-endian 32-bit numbers), low0 and low1 (a bit of each); the last four null without words."""
    import xxhash

    def make():
        def f(texts):
            sets = [shingle_hashes(t, n) for t in texts.to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            full = [s for s in sets if len(s)]
            minima, low0, low1 = iter(()), iter(()), iter(())
            if full:
                joined = np.concatenate(full)
                starts = np.cumsum([0, *map(len, full[:-1])])
                out = np.empty((len(full), len(_FACTORS)), ">u4")
                for k, factor in enumerate(_FACTORS):
                    out[:, k] = np.minimum.reduceat((joined * factor) >> U(32), starts)
                minima = map(bytes, out)
                bits = np.zeros((len(full), 128), np.uint8)
                bits[:, :out.shape[1]] = out & 1
                low0, low1 = map(iter, np.packbits(bits, axis=1).view("<i8").T.tolist())
            return [
                pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()),
                *[pa.array([next(values) if k else None for k in keys], kind) for values, kind in ((minima, pa.binary()), (low0, pa.int64()), (low1, pa.int64()))],
            ]

        return f

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("minima", T.BinaryType()), T.StructField("low0", T.LongType()), T.StructField("low1", T.LongType())]
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("_text"))
    return _shared.map_columns(rows, ["_text"], fields, make, drop=("_text",), owner="words")


def forest(classes: DataFrame, run: int, parts: dict | None = None) -> DataFrame:
    """Each class in its region of each tree, sorted by region: region, what classes has without its minima.

    Where classes has a component, any two of different components that share a whole prefix share a region. parts keeps what was counted: a second call with the same one counts nothing.
    """
    trees = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).withColumn("minima", F.expr(f"substring(minima, tree * {4 * DEPTH} + 1, {4 * DEPTH})"))
    prefix = lambda d: F.substring("minima", 1, 4 * d).alias("prefix")
    if parts is None or "hot" not in parts:
        hot: list[tuple[int, DataFrame]] = []
        rows = trees.select("tree", "minima")
        for d in LEVELS:  # prefixes that too many documents share; a deeper level counts such documents alone, from where they are stored
            if hot:
                rows = _shared.materialise(rows.withColumn("prefix", prefix(hot[-1][0])).join(hot[-1][1], ["tree", "prefix"], "left_semi").select("tree", "minima"), "deeper")
            counts = _shared.materialise(rows.groupBy("tree", prefix(d)).agg(F.count("*").alias("n")).where(F.col("n") > run), "hot")
            if not counts.head(1):
                break
            hot.append((d, counts))
        if parts is not None:
            parts["hot"] = hot
    else:
        hot = parts["hot"]
    rows = trees.withColumn("_depth", F.lit(LEVELS[0])).withColumn("_many", F.lit(1).cast("long"))
    apart = "component" in classes.columns and len(hot) == len(LEVELS)
    for (d, counts), deeper in itertools.zip_longest(hot, LEVELS[1:len(hot) + 1]):
        side = counts.select(F.col("tree").alias("_t"), F.col("prefix").alias("_p"), "n")
        rows = rows.join(side, (F.col("tree") == F.col("_t")) & (F.substring("minima", 1, 4 * d) == F.col("_p")), "left")
        if deeper is None:  # the whole prefix: a ring of blocks of half a run each
            rows = rows.withColumn("_many", F.when(F.col("n").isNotNull(), F.greatest(F.ceil(2 * F.col("n") / run), F.lit(3))).otherwise(F.col("_many")))
        else:
            rows = rows.withColumn("_depth", F.when(F.col("n").isNotNull(), F.lit(deeper)).otherwise(F.col("_depth")))
        rows = rows.drop("_t", "_p", "n")
    own = F.pmod(F.xxhash64("cid", "tree"), F.col("_many"))
    blocks = F.array(own, F.pmod(own + 1, F.col("_many")))
    if apart:  # whole prefixes by component: the most frequent one has blocks of its own, which the others' meet, as these each other
        sizes = rows.where("_many > 1").groupBy("tree", "minima", "component").agg(F.count("*").alias("n")).groupBy("tree", "minima").agg(F.max_by("component", F.struct("n", "component")).alias("_most"), F.max("n").alias("_n"), F.sum("n").alias("_all"))
        of = lambda n: F.ceil(2 * n / run)
        sizes = _shared.materialise(sizes.select(F.col("tree").alias("_t"), F.col("minima").alias("_p"), "_most", of(F.col("_n")).alias("_own"), of(F.col("_all") - F.col("_n")).alias("_rest")), "hot")
        rows = rows.join(sizes, (F.col("tree") == F.col("_t")) & (F.col("minima") == F.col("_p")) & (F.col("_many") > 1), "left")
        mine, most = F.xxhash64("cid", "tree"), F.col("component") == F.col("_most")
        here = F.when(most, F.pmod(mine, F.col("_own"))).otherwise(F.col("_own") + F.pmod(mine, F.col("_rest")))
        met = F.sequence(F.when(most, F.col("_own")).otherwise(F.lit(0)), F.col("_own") + F.col("_rest") - 1)
        # two blocks are a region: the lesser one in the upper half of its number
        blocks = F.when(F.col("_rest") == 0, F.array().cast("array<long>")).otherwise(F.transform(met, lambda x: F.shiftleft(F.least(x, here), 32) + F.greatest(x, here)))
    blocks = F.when(F.col("_many") == 1, F.array(F.lit(0).cast("long"))).otherwise(blocks)
    dealt = rows.withColumn("_block", F.explode(blocks)).withColumn("region", F.expr("xxhash64(tree, substring(minima, 1, 4 * _depth), _block)"))
    dealt = dealt.drop("minima", "tree", "_depth", "_many", "_block", "_t", "_p", "_most", "_own", "_rest")
    return dealt.repartition("region").sortWithinPartitions("region", "cid")


def _bits(percent: float) -> tuple[int, int]:
    """Differing low bits of a pair up to which it is proposed, and up to which it counts as near for centrality."""
    n, j = TREES * DEPTH, percent / 100
    agree = (1 + j) / 2
    return int(np.floor(n * (1 - agree) + SLACK * (n * agree * (1 - agree)) ** 0.5)), int(np.ceil(n * (1 - agree)))


def _compared(batches: Iterator[pa.RecordBatch], run: int, more: tuple[str, ...] = (), runs: int = 32) -> Iterator[list[np.ndarray]]:
    """The regions of rows sorted by region: low, cid and the columns named in more; `runs` runs of rows are held at once."""
    held: list[list[np.ndarray]] = []

    def regions(block: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        cuts = np.flatnonzero(np.diff(block[0])) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), len(block[0])]):
            if b - a > 1:
                yield [x[a:b] for x in block[1:]]

    for batch in batches:
        if batch.num_rows:
            low = np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in ("low0", "low1")])
            held.append([batch.column("region").to_numpy(), low, batch.column("cid").to_numpy(), *[batch.column(c).to_numpy(zero_copy_only=False) for c in more]])
        if sum(len(h[0]) for h in held) >= runs * run:
            block = [np.concatenate(x) for x in zip(*held, strict=True)]
            at = int(np.searchsorted(block[0], block[0][-1]))  # the last region may go on in the next batch
            yield from regions([x[:at] for x in block])
            held = [[x[at:].copy() for x in block]]
    if held:
        yield from regions([np.concatenate(x) for x in zip(*held, strict=True)])
    _shared.trim()


def proposals(sorted_forest: DataFrame, percent: float, run: int = RUN) -> DataFrame:
    """owner, partner, differ: what documents propose in the regions of each sorted partition."""
    far, near = _bits(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def out():
            x = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32))], names=["owner", "partner", "differ"])

        for low, cids in _compared(batches, run):
            x = _region(low, cids, far, near)
            if len(x):
                found.append(x)
            if sum(map(len, found)) >= 16 * run:
                yield out()
        if found:
            yield out()

    schema = T.StructType([T.StructField("owner", T.LongType()), T.StructField("partner", T.LongType()), T.StructField("differ", T.IntegerType())])
    return sorted_forest.mapInArrow(work, schema)


def outside(sorted_forest: DataFrame, percent: float, run: int = RUN) -> DataFrame:
    """a, b, left_a, left_b: pairs of different components (a > b), the nearest OUTSIDE of a document and region; left: whether the document has more there."""
    far, _ = _bits(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region in _compared(batches, run, ("component", "n_shingles")):
            x = _outside(*region, far, percent)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), *[pa.array(x[:, k].astype(bool)) for k in (2, 3)]], names=["a", "b", "left_a", "left_b"])

    return sorted_forest.mapInArrow(work, "a long, b long, left_a boolean, left_b boolean")


def joining(sorted_forest: DataFrame, percent: float, run: int = RUN) -> DataFrame:
    """a, b: links that join the components of a region, confirmed on the sets in column shingles; of those between two components one."""
    far, _ = _bits(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region in _compared(batches, run, ("component", "n_shingles", "shingles"), 2):
            x = _joining(*region, far, percent)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return sorted_forest.mapInArrow(work, "a long, b long")


def _differ(low: np.ndarray) -> np.ndarray:
    """Differing low bits of all pairs."""
    differ = np.zeros((len(low), len(low)), np.uint8)
    for k in range(low.shape[1]):
        differ += np.bitwise_count(low[:, None, k] ^ low[None, :, k])
    return differ


def _apart(low: np.ndarray, component: np.ndarray, size: np.ndarray, percent: float) -> np.ndarray:
    """Differing low bits; 255 within a component and where the numbers of shingles don't allow the similarity."""
    differ = _differ(low)
    differ[component[:, None] == component[None, :]] = 255
    differ[100 * np.minimum(size[:, None], size[None, :]) < percent * np.maximum(size[:, None], size[None, :])] = 255
    return differ


def _outside(low: np.ndarray, ids: np.ndarray, component: np.ndarray, size: np.ndarray, far: int, percent: float) -> np.ndarray:
    """(a, b, left_a, left_b) of a region: the nearest of each document in other components."""
    if (component == component[0]).all():
        return np.zeros((0, 4), np.int64)
    differ = _apart(low, component, size, percent)
    count = (differ <= far).sum(1)
    if count.max() <= OUTSIDE:
        row, col = np.nonzero(np.triu(differ <= far))
    else:
        # ties as in _region
        order = np.argpartition(differ.astype(np.int32) * len(ids) + np.arange(len(ids)), OUTSIDE - 1, axis=1)[:, :OUTSIDE]
        row, col = np.nonzero(np.take_along_axis(differ, order, 1) <= far)
        col = order[row, col]
    more, first = count[row] > OUTSIDE, ids[row] > ids[col]
    return np.column_stack([np.maximum(ids[row], ids[col]), np.minimum(ids[row], ids[col]), more & first, more & ~first])


def _joining(low: np.ndarray, ids: np.ndarray, component: np.ndarray, size: np.ndarray, shingles: np.ndarray, far: int, percent: float) -> np.ndarray:
    """(a, b) of a region: links between different components, none between two that earlier ones have joined."""
    out: list[tuple[int, int]] = []
    if (component == component[0]).all():
        return np.zeros((0, 2), np.int64)
    near = _apart(low, component, size, percent) <= far
    root = np.unique(component, return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in shingles]
    for i, x in enumerate(sets):
        others = i + 1 + np.flatnonzero(near[i, i + 1:])
        for at in range(0, len(others), AT_ONCE):
            js = others[at:at + AT_ONCE]
            js = js[root[js] != root[i]]
            if not len(js):
                continue
            y = np.concatenate([sets[j] for j in js])
            hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *size[js[:-1]]]))
            for j in js[100 * both >= percent * (len(x) + size[js] - both)].tolist():
                if root[j] != root[i]:
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                    root[root == root[j]] = root[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _region(low: np.ndarray, ids: np.ndarray, far: int, near: int) -> np.ndarray:
    """(owner, partner, differ) of a region: the nearest of each document and the one with most near documents."""
    n = len(ids)
    differ = _differ(low)
    np.fill_diagonal(differ, 255)
    some = np.flatnonzero((differ <= far).any(1))
    if not len(some):
        return np.zeros((0, 3), np.int64)
    central = (differ <= near).sum(0)
    d = differ[some]
    k = min(NEAREST, n - 1)
    # ties go to the smaller place, which is the smaller prefix and then the smaller id
    order = np.argpartition(d.astype(np.int32) * n + np.arange(n), k - 1, axis=1)[:, :k]
    hub = np.where(d <= far, central, -1).argmax(1)
    picks = np.concatenate([order, hub[:, None]], 1)
    gap = np.take_along_axis(d, picks, 1)
    row, col = np.nonzero(gap <= far)
    partner = picks[row, col]
    gap = gap[row, col].astype(np.int64)
    gap[col == k] = 0  # the central one is confirmed in the first round
    return np.column_stack([ids[some[row]], ids[partner], gap])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _shared.enter("words")
        kept: dict[int, np.ndarray] = {}
        held = 0

        def of(i, t):
            nonlocal held
            if i not in kept:
                if held >= KEPT_BYTES:
                    kept.clear()
                    held = 0
                kept[i] = shingle_hashes(t, n)
                held += kept[i].nbytes
            return kept[i]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hit = []
            for i, j, s, t in zip(a, b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = of(i, s), of(j, t)
                if len(x) > len(y):
                    x, y = y, x
                both = 0
                if 100 * len(x) >= percent * len(y):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])
        kept.clear()
        _shared.trim()

    side = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(work, "a long, b long")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """joined (id, component) after links (a, b): components are joined with each other, their members follow."""
    at = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    if not links.head(1):
        return joined
    between = links.join(at("a"), "a").join(at("b"), "b")
    moved = components(between, "component_a", "component_b").select(F.col("id").alias("component"), F.col("component").alias("to"))
    return _shared.materialise(joined.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "joined")


def linked(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(documents: id, hash, n_shingles, set_key; classes: set_key, component, first struct<id, hash>, least) of df.

    first: of a component, the document with the least id (null last) and then text hash; least: its least id, null if all are.
    """
    spark = df.sparkSession
    _shared.bounded_batches(spark)
    signed = _shared.materialise(signatures(df, doc_id, text, n), "signatures")
    same = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.coalesce("id", F.lit(LAST_ID)).alias("id"), "hash")).alias("first"), F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("minima", "low0", "low1", "n_shingles")]
    )
    classes = _shared.materialise(same.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits = ["cid", "minima", "low0", "low1"]

    first: dict = {}
    found = proposals(forest(classes.select(*bits), run, first), percent, run)
    rank = Window.partitionBy("owner").orderBy("differ", "partner")
    found = found.groupBy("owner", "partner").agg(F.min("differ").alias("differ"))
    table = _shared.materialise(found.withColumn("rank", F.row_number().over(rank)), "proposals")
    cids = table.select(F.explode(F.array("owner", "partner")).alias("cid"))
    if len(first["hot"]) == len(LEVELS):  # a ring of blocks may keep partners apart: all that share a whole prefix with too many go on
        prefixes = classes.select("cid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.expr("minima").substr(k * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))).alias("tree", "prefix"))
        cids = cids.unionByName(prefixes.join(first["hot"][-1][1], ["tree", "prefix"], "left_semi").select("cid"))
    cids = cids.distinct()
    near = _shared.materialise(classes.join(cids.hint("merge"), "cid", "left_semi"), "near")
    # a class's text is that of its first document. The same plan at every size: texts are dealt once
    wanted = near.select("cid", "first.id", "first.hash")
    texts = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    texts = _shared.materialise(texts.join(wanted.hint("merge"), ["id", "hash"]).select("cid", "text").dropDuplicates(["cid"]), "texts")

    # every class that has a proposal or a hot prefix, with the least class of its component
    joined = near.select(F.col("cid").alias("id"), F.col("cid").alias("component"))
    at = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))

    done = 0
    for most in ROUNDS:
        todo = table.where((F.col("rank") > done) & (F.col("rank") <= most)).select(F.greatest("owner", "partner").alias("a"), F.least("owner", "partner").alias("b")).distinct()
        open_pairs = todo.join(at("a"), "a").join(at("b"), "b").where("component_a <> component_b").select("a", "b")
        joined = _merged(joined, _shared.materialise(confirmed(open_pairs, texts, percent, n), "links"))
        done = most

    parts: dict = {}
    tried = table.select(F.greatest("owner", "partner").alias("a"), F.least("owner", "partner").alias("b"))
    apart = lambda: near.select(*bits, "n_shingles").join(joined.withColumnRenamed("id", "cid"), "cid")
    found = outside(forest(apart(), run, parts), percent, run).groupBy("a", "b").agg(F.max("left_a").alias("left_a"), F.max("left_b").alias("left_b"))
    found = _shared.materialise(found, "outside")
    joined = _merged(joined, _shared.materialise(confirmed(found.join(tried, ["a", "b"], "left_anti").select("a", "b"), texts, percent, n), "links"))
    left = found.select(F.explode(F.array(F.when(F.col("left_a"), F.col("a")), F.when(F.col("left_b"), F.col("b")))).alias("cid")).where("cid is not null").distinct()
    if left.head(1):
        fields = [T.StructField("shingles", T.BinaryType())]
        sets = _shared.map_columns(texts.join(left.hint("merge"), "cid", "left_semi"), ["text"], fields, lambda: lambda t: [pa.array([shingle_hashes(x, n).tobytes() for x in t.to_pylist()], pa.binary())], drop=("text",), owner="words")
        joined = _merged(joined, _shared.materialise(joining(forest(apart().join(sets.hint("merge"), "cid"), run, parts), percent, run), "links"))
    _shared.release(texts)
    placed = classes.select("set_key", "first", "least", "cid").join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    of_component = placed.groupBy("component").agg(F.min("first").alias("first"), F.min("least").alias("least"))
    return signed.select("id", "hash", "n_shingles", "set_key"), placed.select("set_key", "component").join(of_component, "component")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE, run: int = RUN) -> DataFrame:
    """doc_id, n_shingles long, component_id long, kept boolean (the id is the component's least): one row for each row of df."""
    documents, classes = linked(df, doc_id, text, percent, n, run)
    least = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("least"))
    return documents.join(classes.select("set_key", "least"), "set_key", "left").select(
        F.col("id").alias(doc_id), "n_shingles", least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(False)).alias("kept")
    )


def survivors(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """One row of df of each group: that with the least id (nulls last), then text hash, then other columns. Rows without words all stay."""
    documents, classes = linked(df, doc_id, text, percent, n)
    keys = documents.where("set_key is not null").groupBy(F.coalesce("id", F.lit(LAST_ID)).alias("_id"), F.col("hash").alias("_hash")).agg(F.first("set_key").alias("set_key"), F.count("*").alias("_rows"))
    # what goes or is there more than once; everything else stays as it is
    marked = keys.join(classes.select("set_key", "first"), "set_key").withColumn("_first", F.col("first") == F.struct(F.col("_id").alias("id"), F.col("_hash").alias("hash")))
    marked = _shared.materialise(marked.where("not _first or _rows > 1").select("_id", "_hash", "_first"), "marked")
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("carried"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"))
    stay = rows.join(marked, ["_id", "_hash"], "left_anti").select("carried.*")
    again = marked.where("_first").select("_id", "_hash")
    if not again.head(1):
        return stay
    one = rows.join(again, ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.min("carried").alias("carried")).select("carried.*")
    return stay.unionByName(one)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(_shared.table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, n=3)


QUERIES = {"op10_minhash": op10_minhash}
ORACLES = {
    "op10_minhash": r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) end) as s from words
), shingles as (select doc_id, unnest(s) as g from sets),
numbered as (select doc_id, dense_rank() over (order by g) as g from shingles),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from numbered a join numbered b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
half as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * k >= 85 * (len(x.s) + len(y.s) - k)
), links as (select a, b from half union all select b, a from half), reach(id, other) as (
  select a, b from links union select r.id, l.b from reach r join links l on r.other = l.a
), least as (select id, min(other) as other from reach group by id)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id, doc_id <= coalesce(other, doc_id) as kept
from sets left join least on id = doc_id"""
}

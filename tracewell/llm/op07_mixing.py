"""Mixing sources to target weights by temperature.

Source i with share p_i of the tokens gets the weight p_i^t / sum p_j^t. The exponent t is found by bisection: the smallest
in [0, 1] (the flattest mix) that keeps the mix's entropy at or under a target or repeats no source more often than a limit
allows. The weights are realised for a token budget: a source's documents are dealt to blocks, its blocks are put in a new
random order for each pass over the source (an epoch), whole epochs take all documents, and the last, broken epoch takes
blocks in its order until the budget is met, a document at a time in the block where it runs out. A source is read by
epoch, rank (of the block in that epoch's order) and place (in the block). Tokens are words here: the mix comes before the
tokenizer.

The default budget is the least one in which every source is read whole at least once, so nothing is left out and no
source comes more than `most_repeats` times.

A source may hold any part of the rows: shares come from partial sums, blocks have a bounded number of documents, ranks and
running sums of blocks come from buckets of their order (a bucket's total, then the order inside it), and a task puts one
bucket's blocks or one block's documents in order. The plan by source is broadcast up to MOST_SOURCES of them; beyond, every
source's row is dealt to SALTS keys.

Results: a null source is a source of its own; null and empty texts have 0 tokens and are taken in every whole epoch; a
source without tokens has weight 0 and is taken once; repeated rows each count; an empty table gives no rows; clashing
columns of the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import _shared

MOST_REPEATS = 3.0
#: Documents in a block, about.
BLOCK_DOCS = 1024
SEED = 17
#: Each round of the search parts the interval into so many; rounds until it is shorter than 1e-9.
PARTS, ROUNDS = 16, 8
#: Sources up to which their plan (a row each) is broadcast, and keys that a source has beyond.
MOST_SOURCES, SALTS = 100_000, 64
#: Leading bits of a block's order that make its bucket.
BUCKET_BITS = 12
ADDED = ["n_tokens", "epoch", "block", "rank", "place"]


def word_count(text: Column) -> Column:
    """Words between spaces and control white space: the tokens that weights and budgets count."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def shares(tokens: DataFrame) -> DataFrame:
    """_source, docs, tokens, share: a row a source that has tokens or not."""
    per = tokens.groupBy("_source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("_source", "docs", "tokens", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("total")), F.lit(0.0)).alias("share"))


def exponent(share: DataFrame, entropy: float | None = None, most_repeats: float | None = MOST_REPEATS) -> float:
    """The smallest exponent that meets the target, by parting the interval again and again; 1 keeps the shares.

    entropy: the mix's entropy in nats is at most this. most_repeats: no source is read more than so many times as often as
    the one that is read least. Only sums over sources leave the executors.
    """
    live = share.where("share > 0")

    def fits(ts: list[float]) -> list[bool]:
        rows = live.agg(*[x for k, t in enumerate(ts) for x in (
            F.sum(F.pow("share", F.lit(t))).alias(f"z{k}"), F.sum(F.pow("share", F.lit(t)) * F.log("share") * t).alias(f"e{k}"),
            F.max(F.pow("share", F.lit(t - 1))).alias(f"hi{k}"), F.min(F.pow("share", F.lit(t - 1))).alias(f"lo{k}"),
        )]).first()
        out = []
        for k in range(len(ts)):
            z = rows[f"z{k}"]
            mix_entropy = math.log(z) - rows[f"e{k}"] / z if z else 0.0
            repeats = rows[f"hi{k}"] / rows[f"lo{k}"] if z else 1.0
            out.append((entropy is None or mix_entropy <= entropy + 1e-12) and (most_repeats is None or repeats <= most_repeats + 1e-12))
        return out

    if fits([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        ts = [low + (high - low) * k / PARTS for k in range(1, PARTS)]
        met = fits(ts)
        at = met.index(True) if True in met else PARTS - 1
        low, high = (ts[at - 1] if at else low), (ts[at] if at < PARTS - 1 else high)
    return high


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", entropy: float | None = None, most_repeats: float | None = MOST_REPEATS, budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """df's rows as the mix takes them, with n_tokens long, epoch int, block int, rank long and place long.

    keep: the columns to return, all of df's if None, but for those of the names that are added. They travel as one struct, so no
    working column can clash with them. Rows are counted once and written with these columns for the later steps.
    """
    columns = _shared.without(df, ADDED).columns if keep is None else keep
    tokens = _shared.materialise(df.select(F.struct(*([F.col(f"`{c}`") for c in columns] or [F.lit(True)])).alias("carried"), F.col(source).alias("_source"), word_count(F.col(text)).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_hash"), F.col(key).alias("_key")), "tokens")
    share = _shared.materialise(shares(tokens.select("_source", "n_tokens")), "shares")
    t = exponent(share, entropy, most_repeats)
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(t))).otherwise(0.0)
    sums = share.agg(F.sum(weight).alias("z"), F.sum("tokens").alias("total"), F.max(F.when(F.col("share") > 0, F.col("tokens") / weight)).alias("cover")).first()
    z = sums["z"] or 1.0
    # epochs of a source = weight / z * budget / tokens; the least budget that gives every source one is z * max(tokens / weight)
    wanted = float(budget) if budget is not None else (sums["cover"] or 0.0) * z
    epochs = F.when(F.col("tokens") > 0, F.greatest(weight / F.lit(z) * F.lit(wanted) / F.col("tokens"), F.lit(0.0))).otherwise(1.0)
    near = F.round(epochs)
    epochs = F.when(F.abs(epochs - near) < 1e-9, near).otherwise(epochs)
    plan = share.select(
        F.col("_source").alias("_s"), F.floor(epochs).cast("int").alias("whole"), F.round((epochs - F.floor(epochs)) * F.col("tokens")).cast("long").alias("left"),
        F.greatest(F.ceil(F.col("docs") / block_docs), F.lit(1)).cast("long").alias("blocks"),
    )
    if share.count() <= MOST_SOURCES:
        dealt = tokens.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s")))
    else:
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = tokens.withColumn("_salt", F.pmod(F.xxhash64("_hash", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted.withColumnRenamed("_salt", "_k"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_k"))).drop("_salt", "_k")
    dealt = dealt.drop("_s").withColumn("block", F.pmod(F.xxhash64("_hash"), F.col("blocks")).cast("int"))

    per_block = dealt.groupBy("_source", "block", "whole", "left").agg(F.sum("n_tokens").alias("tokens"))
    ordered = _shared.materialise(ranked(per_block.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole")))), seed), "blocks")
    # whole epochs take every block; the broken one blocks in its order, and of the one in which the budget runs out some documents
    taken = ordered.where("epoch < whole or before < left").select(
        F.col("_source").alias("_s"), F.col("block").alias("_b"), F.struct(
            "epoch", "rank", F.when((F.col("epoch") == F.col("whole")) & (F.col("before") + F.col("tokens") > F.col("left")), F.col("left") - F.col("before")).alias("room")
        ).alias("_take"),
    ).groupBy("_s", "_b").agg(F.sort_array(F.collect_list("_take")).alias("_takes"))  # a few epochs of one block
    taken = _shared.materialise(taken, "taken")  # a row a block: its size is known before the documents are joined
    names = ["carried", "n_tokens", "_source", "_hash", "block"]
    rows = dealt.join(taken, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).select(*names, "_key", F.explode("_takes").alias("_take"))
    rows = rows.select(*names, "_key", "_take.*").withColumn("place", F.xxhash64(F.lit(seed + 2), "epoch", "_hash"))
    inside = Window.partitionBy("_source", "block").orderBy("place", "_hash", "_key").rowsBetween(Window.unboundedPreceding, 0)
    broken = rows.where("room is not null").withColumn("_so_far", F.sum("n_tokens").over(inside)).where("_so_far <= room").drop("_so_far")
    out = rows.where("room is null").unionByName(broken)
    return out.select(*[F.col("carried").getField(c).alias(c) for c in columns], "n_tokens", "epoch", "block", "rank", "place")


def ranked(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """blocks (_source, epoch, block, tokens and others) with rank (from 0) and before (tokens of lower ranks) in each epoch's order.

    The order is by a hash; its leading bits make buckets. Only bucket totals of a source and epoch (at most 2**BUCKET_BITS
    rows) and the blocks of one bucket are put in order within a task.
    """
    keys = ["_source", "epoch"]
    hashed = blocks.withColumn("_order", F.xxhash64(F.lit(seed + 1), "epoch", "_source", "block")).withColumn("_bucket", F.shiftright("_order", 64 - BUCKET_BITS))
    totals = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_sum"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("_source").alias("_s"), F.col("epoch").alias("_e"), F.col("_bucket").alias("_c"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_rank"), F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_before"),
    )
    own = Window.partitionBy(*keys, "_bucket").orderBy("_order", "block")
    placed = hashed.withColumn("rank", F.row_number().over(own) - 1).withColumn("before", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    joined = placed.join(totals, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("_bucket") == F.col("_c")))
    return joined.withColumn("rank", F.col("rank") + F.col("_rank")).withColumn("before", F.col("before") + F.col("_before")).drop("_order", "_bucket", "_s", "_e", "_c", "_rank", "_before")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: doc_id, source, n_tokens, epoch, block, rank, place."""
    return mix(_shared.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id", "source"])


QUERIES = {"op7_mixing": op7_mixing}

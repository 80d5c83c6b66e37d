"""Ranks over whole tables without sorting a table in one task.

Values are counted first (ties become one row), the distinct values are dealt to buckets between approximate quantiles,
buckets are summed, and only a bucket's values are put in order within a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.storage import materialise

BUCKETS = 64


def value_ranks(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """Each distinct non-null value v with n (rows that have it), before (rows ahead of it) and total (rows)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = counts.agg(F.percentile_approx("v", cuts).alias("_bounds"))
    dealt = counts.crossJoin(F.broadcast(bounds)).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("v")))).drop("_bounds")
    way = F.desc if descending else F.asc
    sums = dealt.groupBy("_bucket").agg(F.sum("n").alias("_n"))
    every = Window.orderBy(way("_bucket"))  # at most BUCKETS rows
    sums = sums.select("_bucket", (F.sum("_n").over(every) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    line = Window.partitionBy("_bucket").orderBy(way("v")).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(sums), "_bucket").select("v", "n", (F.col("_ahead") + F.sum("n").over(line) - F.col("n")).alias("before"), "total")


def quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """One row: the exact q-quantile of a column, between the two values around it in proportion."""
    at = (F.col("total") - 1) * F.lit(float(q))
    holds = lambda i: F.when((F.col("before") <= i) & (F.col("before") + F.col("n") > i), F.col("v").cast("double"))
    ends = value_ranks(df, value).agg(F.max(holds(F.floor(at))).alias("lo"), F.max(holds(F.ceil(at))).alias("hi"), F.max(at - F.floor(at)).alias("part"))
    return ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(out))


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average-tie rank of value between 0 and 1; a single row has 1, a null null."""
    ranks = value_ranks(df, value).select(F.col("v").alias("_v"), F.when(F.col("total") == 1, 1.0).otherwise((F.col("before") + (F.col("n") - 1) / 2) / (F.col("total") - 1)).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def all_percent_ranks(df: DataFrame, values: list[str], key: str = "id") -> DataFrame:
    """df with percent_ranks of each of values as r_<value>. df is written once: each rank reads it, so the plan stays linear."""
    base = materialise(df, "ranked")
    out = base
    for c in values:
        out = out.join(percent_ranks(base.select(key, c), c, f"r_{c}").select(key, f"r_{c}"), key)
    return out


def dense_numbers(ids: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct non-null values of key with numbers from 0 without gaps, in no order that means anything.

    Values are dealt to buckets by hash, counted by bucket, and put in order within their bucket.
    """
    parts = 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = materialise(ids.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "ids")  # read twice
    sums = base.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sums.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # a row a bucket
    placed = base.join(F.broadcast(before), "_bucket").withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)))
    return placed.select(key, (F.col("_before") + F.col("_in") - 1).alias(out))


def numbered(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """df with its place from 1, the largest value first and ties by key.

    Few values may hold most rows, so ties are dealt to buckets by key, and only a bucket's rows are put in order within a task.
    """
    base = df if "_shared_table" in df.__dict__ else materialise(df, "numbered")  # read four times
    some = base.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(BUCKETS * 16).collect()  # a bounded sample: only how even buckets are depends on it
    cuts = sorted({r[0] for r in some})
    cuts = cuts[:: max(1, len(cuts) // BUCKETS)][1:]
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col(key))) if cuts else F.lit(0)
    ranks = value_ranks(base, value, descending=True).select(F.col("v").alias("_v"), "before")
    dealt = base.where(F.col(value).isNotNull()).withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    lower = Window.partitionBy("_w").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS + 1 rows a value
    sums = dealt.groupBy(F.col(value).alias("_w"), F.col("_bucket").alias("_c")).agg(F.count("*").alias("_n")).select("_w", "_c", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy(value, "_bucket").orderBy(key)
    placed = dealt.withColumn("_row_in", F.row_number().over(own)).join(sums, (F.col(value) == F.col("_w")) & (F.col("_bucket") == F.col("_c"))).join(ranks, F.col(value) == F.col("_v"))
    return placed.withColumn(out, (F.col("before") + F.col("_ahead") + F.col("_row_in")).cast("long")).drop("_v", "before", "_bucket", "_w", "_c", "_ahead", "_row_in")

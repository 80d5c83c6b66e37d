"""Quality of rankings and groupings against truth, and checks of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import value_ranks


def rank_quality(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """k, precision, recall for each k that the ranking reaches, and average_precision on every row. ranked: id, rank; truth: id.

    Only hits are numbered, and there are at most as many as truths.
    """
    t = truth.select("id").distinct()
    total = t.agg(F.count("*").alias("n"))
    reach = ranked.agg(F.max("rank").alias("last"))
    hits = ranked.join(t, "id", "left_semi").select("rank")
    order = value_ranks(hits, "rank").select(F.col("v").alias("rank"), (F.col("before") + 1).alias("found"))
    ap = order.agg(F.coalesce(F.sum(F.col("found") / F.col("rank")), F.lit(0.0)).alias("ap"))
    cuts = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k long")
    at = cuts.join(hits, F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.count("rank").alias("hits"))
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return at.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(ap)).crossJoin(F.broadcast(reach)).where("k <= last").select(
        "k", zero(F.col("hits"), F.col("k")).alias("precision"), zero(F.col("hits"), F.col("n")).alias("recall"), zero(F.col("ap"), F.col("n")).alias("average_precision")
    )


def ari_nmi(df: DataFrame, truth: str, found: str, leave_out: str | None = "UNAFFILIATED") -> DataFrame:
    """ari, nmi (arithmetic mean) of two labellings, from the table of their common counts."""
    kept = df.where(F.col(truth).isNotNull() & F.col(found).isNotNull())
    if leave_out is not None:
        kept = kept.where(F.col(truth).cast("string") != leave_out)
    cells = kept.groupBy(F.col(truth).cast("string").alias("t"), F.col(found).cast("string").alias("f")).agg(F.count("*").cast("double").alias("n"))
    pairs: Column = F.col("n") * (F.col("n") - 1) / 2
    rows = cells.groupBy("t").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("f").agg(F.sum("n").alias("n"))
    a = rows.agg(F.sum(pairs).alias("pa"), F.sum(F.col("n") * F.log("n")).alias("la"))
    b = cols.agg(F.sum(pairs).alias("pb"), F.sum(F.col("n") * F.log("n")).alias("lb"))
    c = cells.agg(F.sum(pairs).alias("pc"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("lc"))
    n, expected = F.col("n"), F.col("pa") * F.col("pb") / (F.col("n") * (F.col("n") - 1) / 2)
    ari = F.try_divide(F.col("pc") - expected, (F.col("pa") + F.col("pb")) / 2 - expected)
    ha, hb, mi = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n, F.log(n) + (F.col("lc") - F.col("la") - F.col("lb")) / n
    return a.crossJoin(b).crossJoin(c).select(F.round(F.coalesce(ari, F.lit(1.0)), 6).alias("ari"), F.round(F.coalesce(F.try_divide(2 * mi, ha + hb), F.lit(1.0)), 6).alias("nmi"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(tp, tp + fp), zero(tp, tp + fn)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(zero(2 * p * r, p + r), 4).alias("f1")]


def entity_prf(gold: DataFrame, found: DataFrame) -> DataFrame:
    """level, label, precision, recall, f1, support: entities doc_id, start, end, text, label, compared as sets.

    strict: place and label; typed: text and label, over all and by label.
    """
    def scored(keys: list[str], level: str, by_label: bool) -> DataFrame:
        g, p = gold.select(*keys).distinct().withColumn("_g", F.lit(1)), found.select(*keys).distinct().withColumn("_p", F.lit(1))
        both = g.join(p, keys, "full")
        label = F.col("label") if by_label else F.lit("_all")
        n = both.groupBy(label.alias("label")).agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
        return n.select(F.lit(level).alias("level"), "label", *prf(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))

    typed = ["doc_id", "text", "label"]
    return scored(["doc_id", "start", "end", "label"], "strict", False).unionByName(scored(typed, "typed", False)).unionByName(scored(typed, "typed", True))


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """check, n: rows whose key no row of parent has."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """check, n: keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def loops(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.agg(F.count_if(F.col(a) == F.col(b)).alias("n")).select(F.lit(name).alias("check"), "n")


def overlapping_spans(spans: DataFrame, name: str) -> DataFrame:
    """check, n: spans (doc_id, start, end) that begin before the one before them ends."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    return spans.withColumn("_before", F.lag("end").over(w)).agg(F.count_if(F.col("start") < F.col("_before")).alias("n")).select(F.lit(name).alias("check"), "n")


def out_of_bounds(spans: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """check, n: spans that aren't where their text is in the document's."""
    j = spans.join(documents.select("doc_id", F.col("text").alias("_text")), "doc_id")
    return j.agg(F.count_if(F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")).alias("n")).select(F.lit(name).alias("check"), "n")


def at_least(value: DataFrame, column: str, least: float, name: str) -> DataFrame:
    """check, n: 0 if a one-row frame's value is at least a bound, else 1."""
    return value.select(F.lit(name).alias("check"), F.when(F.col(column) >= least, 0).otherwise(1).cast("long").alias("n"))


def report(checks: list[DataFrame]) -> DataFrame:
    """check, n, passed."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("passed", F.col("n") == 0)

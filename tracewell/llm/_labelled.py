"""Bounded samples of rows for the classifiers, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts longer than this many bytes are not collected for fitting; scoring reads every text whole.
SAMPLE_TEXT_BYTES = 32_768


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is never learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(df: DataFrame, ids: DataFrame, bound: int, column: str) -> list:
    """column of at most bound rows of df whose doc_id is in ids, the first in the order of a hash: the same ones on every run.

    Rows that share an id give one, the least.
    """
    few = ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    few = few.join(df.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = df.select("doc_id", F.col(column).alias("value")).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("value").alias("value")).collect()  # bounded by few
    return [r["value"] for r in sorted(rows, key=lambda r: r.doc_id)]


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, bound: int, values: tuple[int, ...] = (0, 1)) -> dict[int, list[str]]:
    """For each of the label's values, at most bound texts each of rows that are not held out and of at most SAMPLE_TEXT_BYTES."""
    learn = labels.where(~held_out())
    short = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    return {v: sampled(short, learn.where(F.col(label) == v), bound, "text") for v in values}

"""A training-data pipeline over `documents`: each stage takes all that the one before it kept and returns documents.

Stages with a decision act on it: rejected documents and near copies go, repeated passages are cut out of the texts, sources
are read as often as the mix says. The last stage returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import _shared, op01_bpe, op04_quality, op06_substring, op07_mixing, op10_minhash

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject; they are described once, and scored from what is stored.

    A null text counts as empty, rows that share an id are scored each by its own text, an empty table gives none.
    """
    rows = _shared.materialise(op04_quality.described(_shared.apart(docs, "doc_id", "text"), keep_text=True), "features")
    net = op04_quality.learned(rows.select("doc_id", "features"), _shared.table(spark, sf_dir, "labels"))
    kept = op04_quality.scored(rows, net).where(F.col("quality") >= op04_quality.THRESHOLD)
    return _shared.together(kept, docs.columns, "doc_id", "text")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least id. Documents without words all stay."""
    return op10_minhash.survivors(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier one has; all else of a text stays as it is, line breaks too.

    A null text stays null, rows that share an id remove nothing from each other, a null id comes last, an empty table gives none.
    """
    cut = op06_substring.dedup(_shared.apart(docs, "doc_id", "text", "n_chars"), keep_layout=True)
    hit = F.col("n_removed") > 0
    text = F.when(hit, F.col("kept_text")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _shared.together(cut, docs.columns, "doc_id", "text", "n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it, at least once.

    A null source is a source of its own, a text without words is taken once, repeated rows are mixed each by itself.
    """
    names = ("doc_id", "source", "text")
    return _shared.together(op07_mixing.mix(_shared.apart(docs, *names)), docs.columns, *names)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids and the digests of the ids and of the text decoded from them."""
    proved = op01_bpe.encode_and_prove(docs.select("doc_id", "source", "text"), TOKENIZER)
    return proved.select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", source_mixing),
    ("BPE encoding", bpe_encoding),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of `documents`; each stage's are written as Parquet and read again."""
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _shared.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

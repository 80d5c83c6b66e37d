"""Where results go: artefacts, bulk-load tables with their constraints, and an append-only log of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = ("CONFIRMED", "REJECTED", "DEFERRED")


def artefact(df: DataFrame, folder: str, name: str, fmt: str = "json", most: int | None = None) -> str:
    """df (its first `most` rows, for documents shown to people) under folder/name."""
    path = f"{folder}/{name}"
    (df.limit(most) if most else df).write.mode("overwrite").format(fmt).save(path)
    return path


def csv_with_fields(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named columns with a header; columns that df lacks are empty, others are left out."""
    df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]).write.mode("overwrite").option("header", True).csv(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def bulk_nodes(df: DataFrame, key: str) -> DataFrame:
    """Nodes for a graph store; a repeated key is an error, as its uniqueness constraint would make it."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} is repeated")
    return df


def bulk_edges(df: DataFrame, src: str, dst: str, **sums: str) -> DataFrame:
    """Edges merged by their ends, with a count and the sums named (out=column)."""
    return df.groupBy(src, dst).agg(F.count("*").alias("n"), *[F.sum(c).alias(o) for o, c in sums.items()])


def record_decision(spark: SparkSession, path: str, item_type: str, item_id: str, decision: str, analyst: str, note: str = "") -> None:
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of {', '.join(DECISIONS)}")
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"item_type": item_type, "item_id": item_id, "decision": decision, "analyst": analyst, "note": note}.items()], F.current_timestamp().alias("recorded_at"))
    row.write.mode("append").json(path)


def decisions(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The last decisions, the newest first."""
    schema = "item_type string, item_id string, decision string, analyst string, note string, recorded_at timestamp"
    return spark.read.schema(schema).json(path).orderBy(F.desc("recorded_at"), "item_id").limit(limit)

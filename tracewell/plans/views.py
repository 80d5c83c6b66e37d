"""The driver's tables as the engine's feeds: in Spark, and in DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def v_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments src, dst, amount, ts, channel: senders and receivers in one account id space."""
    channel = F.when(F.col("l_returnflag") == "A", "CASH_DEPOSIT").when(F.col("l_returnflag") == "N", "IMPS").otherwise("CASH_WITHDRAWAL")
    return lines(spark, sf_dir).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_extendedprice").alias("amount"), F.col("o_orderdate").alias("ts"), channel.alias("channel"))


def v_comm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls caller, callee, dur, ts, kind."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("caller"), F.get_json_object("props", "$.k").cast("bigint").alias("callee"), F.col("value").alias("dur"), "ts", F.col("event_type").alias("kind"), "event_id"
    )


RELATIONS = {"1-URGENT": "REPORTS_TO", "2-HIGH": "HANDLER_OF", "3-MEDIUM": "RECRUITED_BY", "4-NOT SPECIFIED": "SUPPLIES_TO", "5-LOW": "ASSOCIATE_OF"}


def v_rel(spark: SparkSession, sf_dir: str, least_discount: float = 0.09) -> DataFrame:
    """Declared relations src, dst, relation, strength, confidence, verified."""
    relation = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in RELATIONS.items()])
    return lines(spark, sf_dir).where(F.col("l_discount") >= least_discount).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), relation.alias("relation"), (F.col("l_discount") * 10).alias("strength"),
        (1 - F.col("l_tax")).alias("confidence"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("verified"),
    )


def v_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.col("event_type").alias("place"), F.date_trunc("hour", "ts").alias("bucket"))


def v_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident"), F.col("l_partkey").alias("person"))


def v_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents between suppliers: large lines of an order."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("incident"), F.col("l_suppkey").alias("person"))


SQL = {
    "v_tx": """v_tx as (select o_custkey as src, l_suppkey as dst, l_extendedprice as amount, o_orderdate as ts,
      case l_returnflag when 'A' then 'CASH_DEPOSIT' when 'N' then 'IMPS' else 'CASH_WITHDRAWAL' end as channel
      from lineitem join orders on l_orderkey = o_orderkey)""",
    "v_comm": "v_comm as (select user_id as caller, cast(json_extract_string(props, '$.k') as bigint) as callee, value as dur, ts, event_type as kind, event_id from events)",
    "v_rel": f"""v_rel as (select o_custkey as src, l_suppkey as dst, case o_orderpriority {' '.join(f"when '{k}' then '{v}'" for k, v in RELATIONS.items())} end as relation,
      l_discount * 10 as strength, 1 - l_tax as confidence, case when l_linestatus = 'F' then 1 else 0 end as verified
      from lineitem join orders on l_orderkey = o_orderkey where l_discount >= 0.09)""",
    "v_presence": "v_presence as (select user_id as person, event_type as place, date_trunc('hour', ts) as bucket from events)",
    "v_incident": "v_incident as (select l_orderkey as incident, l_partkey as person from lineitem)",
    "v_joint": "v_joint as (select l_orderkey as incident, l_suppkey as person from lineitem where l_quantity >= 45)",
}


def sql(*parts: str) -> str:
    """`with` over views by name or further CTEs, and the last part as the query."""
    return "with " + ",\n".join(SQL.get(p, p) for p in parts[:-1]) + "\n" + parts[-1]

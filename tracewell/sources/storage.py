"""Tables in the folder that the driver and all executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Taken only where spark.checkpoint.dir is unset and driver and executors are one process, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tracewell"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir; a machine-local default is taken by local masters alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master or 'this cluster'} share")
    return LOCAL_SHARED


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_table = path
    return out


def measured(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """materialise(df), with aggregates over its rows taken by the tasks that write it: no second job reads the table."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), name)
    return out, seen.get


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """materialise(df) in as many buckets by key as a shuffle has: a join by key that does not broadcast moves only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._shared_table, out._bucketed = path, table
    return out


def release(df: DataFrame) -> None:
    """Removes the table behind what materialise returned; nothing may be read from it any more."""
    path = df.__dict__.pop("_shared_table", None)
    if path:
        spark = df.sparkSession
        if table := df.__dict__.pop("_bucketed", None):
            spark.sql(f"drop table {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""What the operators of this subpackage share: tables, shared storage, and Arrow column mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.storage import materialise, release, shared_dir  # noqa: F401

#: Most rows and about the most bytes of one Arrow batch: texts can be long.
BATCH_ROWS, BATCH_BYTES = 2048, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once. A setting of the session, always the same one; Spark reads it when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names clash with names in any case."""
    taken = {n.lower() for n in names}
    return df.select([f"`{c}`" for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """name, with a mark behind it for as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, and all others as one struct `carried`: no working column can clash with what a user has."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*[f"`{c}`" for c in names], F.struct(*(others or [F.lit(True).alias("none")])).alias("carried"))


def together(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """What apart has put apart, as columns in their order."""
    return df.select([F.col(f"`{c}`") if c in names else F.col("carried").getField(c).alias(c) for c in columns])


def map_columns(df: DataFrame, reads: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list[pa.Array]]], drop: tuple[str, ...] = (), owner: str = "") -> DataFrame:
    """df with columns added batch by batch in Python workers.

    make() runs once a task and returns f(*arrays of reads) -> one Arrow array for each of fields. A column of df whose
    name clashes with one of fields is replaced; columns in drop are read but not returned. owner names the caches that f
    keeps in the worker between tasks; those of others go.
    """
    bounded_batches(df.sparkSession)
    new = [f.name for f in fields]
    kept = [c for c in without(df, [*new, *drop]).columns]
    carried = [c for c in dict.fromkeys([*kept, *reads])]
    source = df.select([f"`{c}`" for c in carried])
    schema = T.StructType([*[source.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        f = make()
        for batch in batches:
            made = f(*[batch.column(batch.schema.get_field_index(c)) for c in reads])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *made], names=[*kept, *new])
            del batch, made
        del f
        trim()

    return source.mapInArrow(run, schema)


_residents: dict[str, Callable[[], None]] = {}


def resident(owner: str, clear: Callable[[], None]) -> None:
    """Tells how to drop the caches that an operator keeps in a worker."""
    _residents[owner] = clear


def enter(owner: str) -> None:
    """A worker outlives stages: it keeps the caches of the operator that it works for, and drops those of all others."""
    for name, clear in _residents.items():
        if name != owner:
            clear()


def trim() -> None:
    """Gives memory that a worker has freed back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass

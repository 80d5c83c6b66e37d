"""Keyed lookups. Where order decides, rows carry _row (their place in the feed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.conf import ACCUSED_ROLES


def _text(c: Column | str, numbers: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(numbers.alias("n"), F.col(c).cast("string").alias("v")))), lambda x: x.v), "|")


def by_id(df: DataFrame, key: str) -> DataFrame:
    """Primary-key lookup: text nulls read as empty; of repeated keys the first row stays (by _row, else the least by its columns in their order)."""
    filled = df.na.fill("")
    rest = [c for c in filled.columns if c != key]
    if not rest:
        return filled.distinct()
    whole = F.struct(*[f"`{c}`" for c in rest])
    first = filled.groupBy(key).agg((F.min_by(whole, "_row") if "_row" in rest else F.min(whole)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.`{c}`").alias(c) for c in filled.columns])


def criminals(persons: DataFrame) -> DataFrame:
    return persons.where(F.col("person_type") == "CRIMINAL")


def first_owner(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value of a key's first row."""
    return df.groupBy(key).agg(F.min_by(value, "_row").alias(value))


def last_wins(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value of a key's last row."""
    return df.groupBy(key).agg(F.max_by(value, "_row").alias(value))


def listed(df: DataFrame, key: str, value: str) -> DataFrame:
    """A key's values in feed order, as text joined by |."""
    return df.groupBy(key).agg(_text(value, F.col("_row")).alias(value), F.count("*").alias("n"))


def accused_of_incident(participants: DataFrame, roles: tuple[str, ...] = ACCUSED_ROLES) -> DataFrame:
    return participants.where(F.col("role_in_incident").isin(*roles)).groupBy("incident_id").agg(F.sort_array(F.collect_set("person_id")).alias("person_ids"))


def incidents_of_person(participants: DataFrame) -> DataFrame:
    return participants.groupBy("person_id").agg(F.sort_array(F.collect_list("incident_id")).alias("incident_ids"))


def neighbours(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected adjacency: id, other (one row each, so that a hub is never one array)."""
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("other")))
    return both.where("id <> other").distinct()

"""Feeds by name: explicit schemas, empty text as null, typed empty frames for missing files, and their provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.storage import materialise

# Parts of column names that hold identifiers, which stay text even if they look like numbers.
IDENTIFIERS = ("msisdn", "imei", "imsi", "account_no", "account_number", "ifsc", "registration_no", "fir_no", "cell_id", "nic_ref", "handle", "email", "plate")

SCHEMAS = {
    "persons": "person_id string, full_name string, first_name string, surname string, alias string, date_of_birth string, native_state string, native_city string, person_type string, role string, syndicate_code string, risk_score int, custody_status string",
    "phones": "phone_id string, msisdn string, subscriber_person_id string, activation_date date, deactivation_date date, is_burner int",
    "person_person": "src_person_id string, dst_person_id string, relation string, strength double, confidence double, source_type string, is_verified int",
    "person_phone": "person_id string, phone_id string, usage_type string, confidence double", "phone_device": "phone_id string, device_id string, imei string, msisdn string",
    "person_account": "person_id string, account_id string, relation string", "person_incident": "incident_id string, person_id string, role_in_incident string, arrested int",
    "person_location": "person_id string, location_id string, observed_on string, confidence double", "incident_vehicle": "incident_id string, vehicle_id string, registration_no string, involvement string",
    "colocation_observations": "person_a string, person_b string, location_id string, observed_on string, time_gap_minutes int, source_type string, confidence double",
    "incidents": "incident_id string, crime_type string, state string, area string, city string, incident_datetime timestamp_ntz, investigating_agency string, syndicate_code string",
    "cdr": "cdr_id string, caller_phone_id string, callee_phone_id string, caller_person_id string, callee_person_id string, timestamp timestamp_ntz, duration_sec int, imei string",
    "transactions": "txn_id string, src_account_id string, dst_account_id string, src_person_id string, dst_person_id string, amount_inr long, channel string, timestamp timestamp_ntz",
    "locations": "location_id string, area string, city string, state string", "organizations": "org_id string, name string, org_type string",
}
DOCUMENT = "doc_id string, doc_type string, text string, linked_person_ids array<string>, entities array<struct<start:int,end:int,text:string,label:string,entity_id:string>>"


@dataclass(frozen=True)
class Feed:
    name: str
    path: str
    source_system: str = ""
    entity: str = ""
    kind: str = "csv"  # csv, json, parquet or truth (csv, all text)


class Catalog:
    """Feeds of one dataset. catalog["persons"] or catalog.persons reads one; an unknown name is a KeyError."""

    def __init__(self, spark: SparkSession, feeds: list[Feed]):
        self.spark = spark
        self.feeds = {f.name: f for f in feeds}
        self._read: dict[str, DataFrame] = {}
        self._placed: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.feeds:
            raise KeyError(name)
        if name not in self._read:
            self._read[name] = self._open(self.feeds[name])
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        feeds = self.__dict__.get("feeds", {})
        if name not in feeds:
            raise AttributeError(name)
        return self[name]

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def string_schema(self, path: str) -> T.StructType:
        """Columns of a CSV file's header, all text."""
        header = self.spark.read.option("header", True).csv(path).columns
        return T.StructType([T.StructField(c, T.StringType()) for c in header])

    def ordered(self, name: str) -> DataFrame:
        """A feed with _row, each row's place in it from 0: by file name, then as the file has it.

        A task reads splits from beginning to end, so a running number of the task, less the split's least, is a row's place in
        its split; splits are counted, and their counts add up in the order of file and offset. However many files and splits
        there are, places are those of a single reader. Rows are stored with their split once, since a second reading may split
        otherwise; only counts of splits, not rows, are put in order in one task.
        """
        if name not in self.feeds:
            raise KeyError(name)
        if name not in self._placed:
            feed = self.feeds[name]
            if not self._exists(feed.path):
                self._placed[name] = self._open(feed).withColumn("_row", F.lit(None).cast("long"))
            else:
                rows = materialise(self._open(feed, placed=True).withColumn("_line", F.monotonically_increasing_id()), "placed")
                splits = rows.groupBy("_file", "_offset").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
                before = Window.orderBy("_file", "_offset").rowsBetween(Window.unboundedPreceding, -1)
                splits = splits.select("_file", "_offset", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
                placed = rows.join(splits, ["_file", "_offset"]).withColumn("_row", F.col("_before") + F.col("_line") - F.col("_first"))
                self._placed[name] = placed.drop("_file", "_offset", "_first", "_before", "_line")
        return self._placed[name]

    def _open(self, feed: Feed, placed: bool = False) -> DataFrame:
        """placed: with the file and the offset of the split that each row comes from."""
        split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_offset")] if placed else []
        declared = T.StructType.fromDDL(DOCUMENT if feed.kind == "json" else SCHEMAS.get(feed.name, "id string"))
        if not self._exists(feed.path):
            return self.spark.createDataFrame([], declared)
        if feed.kind == "parquet":
            return self.spark.read.parquet(feed.path).select("*", *split)
        if feed.kind == "json":
            return self.spark.read.schema(declared).json(feed.path).select("*", *split)
        text = self.spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").schema(self.string_schema(feed.path)).csv(feed.path)
        named = text.columns
        text = text.select([F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in named] + split)
        if feed.kind == "truth":
            return text
        kinds = {f.name: f.dataType for f in declared}
        keep = lambda c: c not in kinds or any(i in c for i in IDENTIFIERS)
        return text.select([F.col(f"`{c}`") if keep(c) else F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in named] + text.columns[len(named):])

    def documents(self, *names: str) -> DataFrame:
        """Text feeds, all of kind json if none is named, one after another."""
        out = None
        for n in names or [f.name for f in self.feeds.values() if f.kind == "json"]:
            out = self[n] if out is None else out.unionByName(self[n])
        return self.spark.createDataFrame([], DOCUMENT) if out is None else out

    def views(self) -> None:
        for name in self.feeds:
            self[name].createOrReplaceTempView(name)

    def summary(self) -> DataFrame:
        """feed, source_system, entity, rows: the largest first."""
        out = None
        for f in self.feeds.values():
            part = self[f.name].agg(F.count("*").alias("rows")).select(F.lit(f.name).alias("feed"), F.lit(f.source_system).alias("source_system"), F.lit(f.entity).alias("entity"), "rows")
            out = part if out is None else out.unionByName(part)
        return out.orderBy(F.desc("rows"), "feed")

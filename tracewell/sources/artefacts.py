"""A versioned store of artefacts: tables are staged under names of their own, and one manifest, put in place at the end, makes
all of them the new version at once. Readers follow a manifest, so they see a whole version or the one before it, never a mix.

Results: a run that fails leaves the last version as it was and its own staged tables are removed; a name that a version
lacks is read as an empty table of the default schema, or is a KeyError without one; a store without a version has no
tables; staging a name twice keeps the later table. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Versions under root, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: dict[str, dict] = {}

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _remove(self, *parts: str) -> None:
        fs, path = self._path(*parts)
        fs.delete(path, True)

    def versions(self) -> list[int]:
        """Published versions, the oldest first."""
        fs, folder = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """table, rows and schema by name, of a version or of the last one."""
        known = self.versions()
        if version is None and not known:
            return {}
        version = known[-1] if version is None else version
        if version not in known:
            raise KeyError(f"no version {version}")
        fs, path = self._path("manifests", f"{version:08d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def stage(self, name: str, df: DataFrame) -> None:
        """Writes df; no reader sees it before publish()."""
        seen, table = Observation(), f"{name}-{uuid.uuid4().hex}"
        try:
            df.observe(seen, F.count("*").alias("rows")).write.parquet(f"{self.root}/tables/{table}")
        except Exception:
            self._remove("tables", table)
            raise
        before = self._staged.pop(name, None)
        self._staged[name] = {"table": table, "rows": seen.get["rows"], "schema": df.schema.jsonValue()}
        if before:
            self._remove("tables", before["table"])

    def publish(self, keep_others: bool = False) -> int:
        """The staged tables as a new version; keep_others takes along what else the last one has."""
        tables = (self.manifest() if keep_others else {}) | self._staged
        version = (self.versions() or [0])[-1] + 1
        fs, made = self._path("manifests", f".{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        _, place = self._path("manifests", f"{version:08d}.json")
        if fs.exists(place) or not fs.rename(made, place):
            fs.delete(made, False)
            raise RuntimeError(f"version {version} has been published by another writer")
        self._staged = {}
        return version

    def discard(self) -> None:
        for entry in self._staged.values():
            self._remove("tables", entry["table"])
        self._staged = {}

    @contextmanager
    def run(self, keep_others: bool = False) -> Iterator[Store]:
        """Publishes at the end of the block; if it raises, nothing changes."""
        try:
            yield self
            self.publish(keep_others)
        except BaseException:
            self.discard()
            raise

    def read(self, name: str, default: T.StructType | str | None = None, version: int | None = None) -> DataFrame:
        entry = self.manifest(version).get(name)
        if entry:
            return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.root}/tables/{entry['table']}")
        if default is None:
            raise KeyError(name)
        return self.spark.createDataFrame([], default)

    def paths(self, version: int | None = None) -> dict[str, str]:
        return {name: f"{self.root}/tables/{entry['table']}" for name, entry in self.manifest(version).items()}

    def contents(self, version: int | None = None) -> DataFrame:
        """name, rows of a version's tables, from the manifest alone."""
        return self.spark.createDataFrame([(n, e["rows"]) for n, e in sorted(self.manifest(version).items())], "name string, rows long")

    def prune(self, keep: int = 2) -> None:
        """Removes all but the last `keep` versions, and the tables that only they have."""
        if keep < 1:
            raise ValueError("the last version stays")
        known = self.versions()
        live = {e["table"] for v in known[-keep:] for e in self.manifest(v).values()}
        for v in known[:-keep]:
            old = {e["table"] for e in self.manifest(v).values()}
            self._remove("manifests", f"{v:08d}.json")
            for table in old - live:
                self._remove("tables", table)

"""Sharding: arrivals become small immutable runs, runs of like size merge, and a versioned manifest says which count."""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


class Taken(Exception):
    """Another writer has committed the version."""


def united(old: str | None, new: StructType) -> str:
    """The schema, as JSON, with the fields of both, old ones first; names that differ in case alone are one. ValueError: a name with two types."""
    fields = [StructField(f.name, f.dataType) for f in (StructType.fromJson(json.loads(old)) if old else [])]
    known = {f.name.lower(): f.dataType for f in fields}
    for f in new:
        kind = known.setdefault(f.name.lower(), f.dataType)
        if kind != f.dataType:
            raise ValueError(f"column {f.name} is {kind.simpleString()} in the store and {f.dataType.simpleString()} in these rows")
        if len(known) > len(fields):
            fields.append(StructField(f.name, f.dataType))
    return StructType(fields).json()


class ShardStore:
    """A collection of rows in a folder that Spark reads and writes, by any number of writers.

    manifests/N.json lists the runs of version N, each with its tier, bytes, files and rows: nothing but these counts. A commit
    writes the new manifest beside and renames it to the next number, which fails if another writer has taken it; the
    writer then reads the manifest again and commits its run on top of that. Readers see the old or the new version,
    whole. The rename has to be atomic, as on HDFS and local disks; on object stores it is not.

    Runs are never changed. A writer leaves intents/ID before it writes run ID and takes it away after the commit;
    vacuum() deletes runs that neither a kept version nor an intent younger than grace_seconds names.

    The store's columns are those of all appends: a row has nulls in those that its append didn't have. An append in which a column has
    another type than in the store raises ValueError and stores nothing. Nulls, repeated rows and extra columns are stored as they are. Appending an empty table makes a version with the
    same runs and an empty one. Reading a store without versions raises ValueError. A writing task holds a row group
    of group_bytes, which is looked at every ten rows, so texts of megabytes don't add up to much more.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fan_in: int = 4, base_bytes: int = 1 << 20, grace_seconds: int = 24 * 3600, group_bytes: int = 16 << 20):
        self.spark, self.path, self.target_bytes, self.fan_in, self.base_bytes, self.grace_seconds = spark, path.rstrip("/"), target_bytes, fan_in, base_bytes, grace_seconds
        self.group = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10}
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list:
        return list(self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._names("manifests"))
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._at(f"manifests/{version or found[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, old: dict, runs: list[dict], schema: str) -> dict:
        """The version after old. Raises Taken if there is one already."""
        new = {"version": old["version"] + 1, "schema": schema, "runs": runs}
        beside = self._at(f"manifests/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(self._at(f"manifests/{new['version']}.json")), no_overwrite)
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Taken(f"version {new['version']} exists") from e
            raise
        return new

    def _write(self, df: DataFrame) -> dict:
        ident = uuid.uuid4().hex
        self._fs.create(self._at(f"intents/{ident}"), False).close()
        df.write.options(**self.group).parquet(f"{self.path}/runs/{ident}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/runs/{ident}").count()  # of the files' footers
        files = [x for x in self._names(f"runs/{ident}") if x.getPath().getName().endswith(".parquet")]
        size = sum(x.getLen() for x in files)
        return {"run": f"runs/{ident}", "bytes": size, "files": len(files), "rows": rows, "tier": max(0, math.ceil(math.log(max(size, 1) / self.base_bytes, self.fan_in)))}

    def _settled(self, run: dict) -> None:
        self._fs.delete(self._at(run["run"].replace("runs/", "intents/", 1)), False)

    def append(self, df: DataFrame) -> dict:
        """Stores df as one run of small files, one for each of its partitions, and commits."""
        united(self.manifest()["schema"], df.schema)
        run = self._write(df)
        while True:
            old = self.manifest()
            try:
                new = self.commit(old, [*old["runs"], run], united(old["schema"], df.schema))
            except Taken:
                continue
            self._settled(run)
            return new

    def _runs(self, runs: list[dict], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{self.path}/{r['run']}" for r in runs])

    def compact(self) -> dict:
        """Merges the runs of a tier, when there are fan_in or more, into files of about target_bytes; so on up the tiers.

        No row is shuffled: a task reads some files one after the other and writes one. If another writer has merged one of the
        runs meanwhile, this one's work is dropped.
        """
        now = self.manifest()
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in now["runs"]:
                tiers.setdefault(r["tier"], []).append(r)
            full = next((rs for _, rs in sorted(tiers.items()) if len(rs) >= self.fan_in), None)
            if full is None:
                return now
            files = max(1, math.ceil(sum(r["bytes"] for r in full) / self.target_bytes))
            merged = self._write(self._runs(full, now["schema"]).coalesce(files))
            merged["tier"] = max(merged["tier"], 1 + max(r["tier"] for r in full))
            while all(r in now["runs"] for r in full):
                try:
                    now = self.commit(now, [*[r for r in now["runs"] if r not in full], merged], now["schema"])
                    break
                except Taken:
                    now = self.manifest()
            else:
                self._fs.delete(self._at(merged["run"]), True)
            self._settled(merged)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["runs"]:
            raise ValueError("the store has no version yet")
        return self._runs(found["runs"], found["schema"])

    def vacuum(self, keep: int = 1) -> None:
        """Deletes old manifests but the last keep, then runs that none of those and no writer at work has.

        Runs are listed first, then intents, then versions: a listed run is named by its intent until a version names it.
        """
        runs = self._names("runs")
        now = self._jvm.java.lang.System.currentTimeMillis()
        at_work = {x.getPath().getName() for x in self._names("intents") if now - x.getModificationTime() < self.grace_seconds * 1000}
        found = self.versions()
        used = {r["run"] for v in found[-keep:] for r in self.manifest(v)["runs"]}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"manifests/{v}.json"), False)
        for x in runs:
            name = x.getPath().getName()
            if f"runs/{name}" not in used and name not in at_work:
                self._fs.delete(x.getPath(), True)
                self._fs.delete(self._at(f"intents/{name}"), False)

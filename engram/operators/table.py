"""Stored tables in buckets by key: a merge rewrites the buckets that it touches, and a versioned manifest says which files count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.operators.cut import cut


class Conflict(Exception):
    """Another writer has committed the version."""


class Versioned:
    """A folder with manifests/N.json for version N; the newest says what counts. A commit is a rename that fails where the version exists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list:
        return list(self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._names("manifests"))
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def _read(self, version: int | None, empty: dict) -> dict:
        """The newest version or a given one; empty where there is none yet."""
        found = self.versions()
        if not found:
            return empty
        stream = self._fs.open(self._at(f"manifests/{version or found[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, new: dict) -> dict:
        """Makes new the version that it names. Conflict if there is one."""
        beside = self._at(f"manifests/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(self._at(f"manifests/{new['version']}.json")), self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new


class KeyedTable(Versioned):
    """Rows of one schema, in a folder that Spark reads and writes, by any number of writers.

    A row is in the bucket that the hash of its keys has; nulls in keys are values like others. manifests/N.json lists for each
    bucket of version N the runs that have its rows and how many. A merge reads the buckets that its changes
    fall into, writes their new rows as one run and commits version N + 1 by a rename that fails where that exists. A writer
    that comes second keeps its run if none of its buckets has changed meanwhile, and merges again if one has. So two writers
    never lose each other's rows, and readers see a version whole. The rename has to be atomic, as on HDFS and local disks.

    batch: (writer, number) of a merge; one with a number up to the writer's last is nothing, so a repeated batch, as of a stream
    that starts again, isn't applied twice. A writer that dies leaves a run that no version names; vacuum() deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64, rows_per_file: int = 1_000_000):
        super().__init__(spark, path)
        self.keys, self.buckets, self.rows_per_file = list(keys), buckets, rows_per_file
        self.schema = StructType.fromDDL(schema)

    def manifest(self, version: int | None = None) -> dict:
        """The newest version, or a given one. ValueError: the table was made with other keys or buckets."""
        out = self._read(version, {"version": 0, "keys": self.keys, "buckets": self.buckets, "rows": {}, "runs": {}, "batches": {}})
        if (out["keys"], out["buckets"]) != (self.keys, self.buckets):
            raise ValueError(f"the table has {out['buckets']} buckets by {out['keys']}")
        return out

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/runs/{manifest['runs'][b]}/_bucket={b}" for b in sorted(buckets) if b in manifest["runs"]]
        if paths:
            return self.spark.read.schema(self.schema).parquet(*paths)
        # a plan that is known to be empty, so that the first merge needs no join
        return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]).where(F.lit(False))

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """All rows of the newest version or a given one. With keys: of the buckets alone that those rows fall into, at most one number for each comes to the driver."""
        now = self.manifest(version)
        wanted = now["runs"] if keys is None else self._touched(keys)
        return self._rows(now, wanted)

    def _touched(self, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}

    def _write(self, rows: DataFrame, expected: int) -> tuple[str, dict[str, int]]:
        """A run of these rows and how many each bucket has. A bucket is in one file, or in as many as rows_per_file asks for."""
        run = uuid.uuid4().hex
        self._fs.create(self._at(f"intents/{run}"), False).close()
        files = max(1, -(-expected // self.rows_per_file))
        salt = F.pmod(F.xxhash64(F.lit(7), *self.keys), F.lit(files))
        names = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        dealt = rows.select(*names).withColumn("_bucket", self._bucket()).repartition("_bucket", salt)
        dealt.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/runs/{run}")
        kept = [p for p in self._names(f"runs/{run}") if p.getPath().getName().startswith("_bucket=")]
        if not kept:
            return run, {}
        counts = self.spark.read.schema(StructType([*self.schema]).add("_bucket", "integer")).option("basePath", f"{self.path}/runs/{run}").parquet(f"{self.path}/runs/{run}").groupBy("_bucket").count().collect()
        return run, {str(r[0]): r[1] for r in counts}

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None, only: dict | None = None) -> dict:
        """Commits combine(stored rows of the touched buckets, changes) in their place, and returns the manifest.

        combine works key by key and keeps the stored rows that it has no change for; changes are computed once. Without changes nothing is
        committed. only: a manifest that has to be the newest still in the touched buckets, else Conflict is raised in place of another try.
        """
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now
        changes = cut(changes)
        touched = self._touched(changes)
        base, first = only or now, True
        while True:
            if not first and only:
                raise Conflict("a touched bucket has changed")
            first = False
            stored = self._rows(base, touched)
            expected = max([base["rows"].get(b, 0) for b in touched], default=0)
            run, rows = self._write(combine(stored, changes), expected) if touched else ("", {})
            while True:
                now = self.manifest()
                if batch and now["batches"].get(batch[0], -1) >= batch[1] or not touched and not batch:
                    return self._left(run, now)
                if any(now["runs"].get(b) != base["runs"].get(b) for b in touched):
                    break
                new = now | {"version": now["version"] + 1, "runs": {b: r for b, r in now["runs"].items() if b not in touched} | dict.fromkeys(rows, run), "rows": {b: n for b, n in now["rows"].items() if b not in touched} | rows}
                if batch:
                    new["batches"] = now["batches"] | {batch[0]: batch[1]}
                try:
                    self.commit(new)
                except Conflict:
                    continue
                self._fs.delete(self._at(f"intents/{run}"), False)
                return new
            self._left(run, now)
            base = now

    def _left(self, run: str, now: dict) -> dict:
        """Takes a run away that no version will name."""
        if run:
            self._fs.delete(self._at(f"runs/{run}"), True)
            self._fs.delete(self._at(f"intents/{run}"), False)
        return now

    def vacuum(self, keep: int = 1, grace_seconds: int = 24 * 3600) -> None:
        """Deletes manifests but the last keep, and runs that none of those and no intent younger than grace_seconds names."""
        runs = self._names("runs")
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        at_work = {x.getPath().getName() for x in self._names("intents") if now - x.getModificationTime() < grace_seconds * 1000}
        found = self.versions()
        used = {r for v in found[-keep:] for r in self.manifest(v)["runs"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"manifests/{v}.json"), False)
        for name in {x.getPath().getName() for x in runs} - used - at_work:
            self._left(name, {})


def _over(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides of each key: stored columns as they are, those of changes with an underscore before; one row for each key of either."""
    new = changes.select(*(F.col(c).alias(f"_{c}") for c in changes.columns), F.lit(True).alias("_new"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return stored.withColumn("_old", F.lit(True)).join(new, same, "full").withColumns({k: F.when(F.col("_old"), F.col(k)).otherwise(F.col(f"_{k}")) for k in keys})


THOUGHTS = "fingerprint string, content string, metadata map<string,string>, writes bigint"
EDGES = "from_id bigint, to_id bigint, relation string, support bigint, confidence double"


def store_thoughts(table: KeyedTable, writes: DataFrame, batch: tuple[str, int] | None = None) -> dict:
    """Upserts thoughts (content, metadata as a map, seq) into a table of THOUGHTS by fingerprint: new metadata over old, the first content stays, writes are counted.

    The batch is summed to a row for each fingerprint before it meets the table.
    """
    from engram.functions.values import merged_maps
    from engram.operators.upsert import upsert_thoughts

    def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = _over(stored, new, ["fingerprint"])
        return both.select("fingerprint", F.when(F.col("_old"), F.col("content")).otherwise(F.col("_content")).alias("content"), merged_maps(F.col("metadata"), F.col("_metadata")).alias("metadata"), (F.coalesce("writes", F.lit(0)) + F.coalesce("_writes", F.lit(0))).alias("writes"))

    return table.merge(upsert_thoughts(writes.limit(0), writes), combine, batch)


def store_edges(table: KeyedTable, mentions: DataFrame, symmetric: bool = False, batch: tuple[str, int] | None = None) -> dict:
    """Adds mentions (from_id, to_id, relation, confidence) to a table of EDGES: support is summed and the highest confidence stays."""
    from engram.operators.upsert import upsert_edges

    def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
        return stored.unionByName(new).groupBy("from_id", "to_id", "relation").agg(F.sum("support").alias("support"), F.max("confidence").alias("confidence"))

    return table.merge(upsert_edges(mentions, symmetric), combine, batch)


def store_rows(table: KeyedTable, rows: DataFrame, batch: tuple[str, int] | None = None, replace: bool = True) -> dict:
    """Rows by key: they replace the stored ones, or with replace False only those that aren't stored yet go in. Of rows that repeat a key one counts, the first by all its columns."""
    names = [f.name for f in table.schema]
    one = rows.groupBy(*table.keys).agg(F.min(F.struct(*(c for c in names if c not in table.keys))).alias("_v")).select(*table.keys, "_v.*")

    def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = _over(stored, new, table.keys)
        pick = (F.col("_new") if replace else F.lit(False)) | F.col("_old").isNull()
        return both.select(*(F.when(pick, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c not in table.keys else F.col(c) for c in names))

    return table.merge(one, combine, batch)


def remove_rows(table: KeyedTable, ids: DataFrame, batch: tuple[str, int] | None = None) -> dict:
    """Deletes the stored rows with these keys."""
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in table.keys])
    return table.merge(ids.select(*table.keys).distinct(), lambda stored, gone: stored.join(gone, same(stored, gone), "left_anti"), batch)


def sink(table: KeyedTable, store: Callable, writer: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream: each batch goes into table by store once, also if the stream starts again from a checkpoint."""
    return lambda rows, number: store(table, rows, batch=(writer, number))


QUEUE = "id bigint, queued_at bigint, status string, attempts int, last_error string, worker string, lease_until bigint"


class WorkQueue:
    """Items in a stored table that workers claim, each for a time.

    A claim is a conditional commit: it holds only if the buckets of its items are those it read, so no two workers have one item at a
    time, whatever they do at once. An item whose lease has run out counts as pending, and its old worker can't settle it any more. Times are
    numbers that callers give.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most_attempts: int = 5):
        self.table, self.most = KeyedTable(spark, path, QUEUE, ["id"], buckets), most_attempts

    def put(self, items: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Items (id, queued_at) become pending; those that are pending or at work stay as they are, settled ones start anew."""
        fresh = items.groupBy("id").agg(F.min("queued_at").cast("bigint").alias("queued_at")).select("id", "queued_at", *(F.lit(v).cast(t).alias(c) for c, v, t in (("status", "pending", "string"), ("attempts", 0, "int"), ("last_error", None, "string"), ("worker", None, "string"), ("lease_until", None, "bigint"))))

        def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
            both = _over(stored, new, ["id"])
            again = F.col("_old").isNull() | F.col("_new") & F.col("status").isin("complete", "failed")
            return both.select("id", *(F.when(again, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in [f.name for f in self.table.schema][1:]))

        self.table.merge(fresh, combine, batch)

    def claim(self, worker: str, limit: int, now: int, lease: int) -> list[int]:
        """Ids of the oldest items that are free, at most limit, that worker has from now until now + lease. A lost race is tried again.

        The ids of one claim come to the driver: limit bounds them.
        """
        while True:
            base = self.table.manifest()
            free = self._free(now)
            ids = [r.id for r in self.table._rows(base, base["runs"]).where(free).orderBy("queued_at", "id").limit(limit).select("id").collect()]
            if not ids:
                return []
            mine = self.table.spark.createDataFrame([(i,) for i in ids], "id bigint")

            def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
                got = F.col("_new") & self._free(now)
                at_work = {"status": F.lit("processing"), "worker": F.lit(worker), "lease_until": F.lit(now + lease).cast("bigint")}
                return _over(stored, new, ["id"]).where("_old").select(*(F.when(got, at_work[f.name]).otherwise(F.col(f.name)).alias(f.name) if f.name in at_work else F.col(f.name) for f in self.table.schema))

            try:
                self.table.merge(mine, combine, only=base)
            except Conflict:
                continue
            return ids

    @staticmethod
    def _free(now: int):
        return F.coalesce((F.col("status") == "pending") | (F.col("status") == "processing") & (F.col("lease_until") <= now), F.lit(False))

    def settle(self, worker: str, outcomes: DataFrame, now: int) -> None:
        """Outcomes (id, outcome, error) of items that worker still has: complete, release (given back, no attempt counted), or error, which counts and after the most attempts fails."""
        one = outcomes.groupBy("id").agg(F.min(F.struct("outcome", "error")).alias("o")).select("id", "o.*")

        def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
            mine = F.coalesce(F.col("_new") & (F.col("status") == "processing") & (F.col("worker") == worker) & (F.col("lease_until") > now), F.lit(False))
            wrong = mine & ~F.col("_outcome").isin("complete", "release")
            attempts = F.col("attempts") + wrong.cast("int")
            status = F.when(F.col("_outcome") == "complete", "complete").when(wrong & (attempts >= self.most), "failed").otherwise("pending")
            back = mine & (status == "pending")
            after = {"status": F.when(mine, status).otherwise(F.col("status")), "attempts": attempts, "last_error": F.when(wrong, F.substring("_error", 1, 500)).otherwise(F.col("last_error")), "worker": F.when(~back, F.col("worker")), "lease_until": F.when(~mine, F.col("lease_until"))}
            return _over(stored, new, ["id"]).where("_old").select(*(after.get(f.name, F.col(f.name)).alias(f.name) for f in self.table.schema))

        self.table.merge(one, combine)

    def read(self) -> DataFrame:
        return self.table.read()

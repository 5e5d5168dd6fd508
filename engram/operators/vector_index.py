"""A stored index of vectors: inverted lists by coarse centroids, searched by pruned lists and compared exactly."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators.cut import cut
from engram.operators.table import Conflict, Versioned


def _usable(v: Column) -> Column:
    """Vectors with a direction: neither null nor empty nor zero, all entries finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array | pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64) if isinstance(column, pd.Series) else column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


class VectorIndex(Versioned):
    """Vectors (id, embedding) by the centroid that they are nearest to, in immutable segments; a manifest says which count.

    Centroids are trained once, by rounds of k-means in Spark over a sample of at most `sample` vectors; all vectors are indexed, those
    appended later too, without training. A list is as large as its vectors are many: it is dealt out in parts of `part` rows, each met by blocks of
    the queries that look into its list, so no task holds a list. Vectors without a direction, or of another length than the centroids, are in no list.
    """

    def __init__(self, spark: SparkSession, path: str, part: int = 20_000):
        super().__init__(spark, path)
        self.part = part

    def manifest(self, version: int | None = None) -> dict:
        return self._read(version, {"version": 0, "centroids": None, "segments": [], "rows": {}, "reach": {}})

    def _centroids(self, manifest: dict) -> np.ndarray:
        """All centroids, in order of their lists: lists x dimensions numbers, a bound that build() sets."""
        rows = self.spark.read.parquet(f"{self.path}/{manifest['centroids']}").orderBy("list").toPandas()
        return np.stack(rows["vector"].to_numpy())

    def build(self, vectors: DataFrame, lists: int | None = None, rounds: int = 6, sample: int = 200_000, most_lists: int = 4096) -> dict:
        """Trains centroids and indexes all of vectors as the first segment. lists: the square root of their number, if not given. ValueError: nothing to index."""
        usable = vectors.where(_usable(F.col("embedding"))).select("id", "embedding")
        n = usable.count()
        if not n:
            raise ValueError("there is no vector to index")
        lists = min(lists or math.isqrt(n), most_lists, n)
        place = F.xxhash64(F.lit(5), "embedding")
        share = min(1.0, sample / n)
        chosen = cut(usable.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("embedding", place.alias("place")))
        size = chosen.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if size is None:
            chosen, size = cut(usable.select("embedding", place.alias("place"))), usable.select(F.size("embedding").alias("d")).first()
        chosen = chosen.where(F.size("embedding") == size[0])
        start = chosen.dropDuplicates(["place"]).orderBy("place").limit(lists).select("embedding").toPandas()
        centroids = _unit(start["embedding"])
        for _ in range(rounds):
            sums = chosen.mapInArrow(_summing(centroids), "list int, n long, total array<double>").groupBy("list").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(size[0]))).toPandas()
            total = sums[[f"t{k}" for k in range(size[0])]].to_numpy()
            length = np.linalg.norm(total, axis=1)
            centroids = centroids.copy()
            centroids[sums["list"].to_numpy()[length > 0]] = total[length > 0] / length[length > 0, None]
        name = f"centroids-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centroids)], "list int, vector array<double>").coalesce(1).write.parquet(f"{self.path}/{name}")
        base = self.manifest()
        segment, rows, reach = self._segment(usable, centroids)
        return self.commit({"version": base["version"] + 1, "centroids": name, "segments": [segment], "rows": rows, "reach": reach})

    def append(self, vectors: DataFrame) -> dict:
        """Indexes more vectors as a segment of its own, by the centroids that there are."""
        centroids = self._centroids(self.manifest())
        segment, rows, reach = self._segment(vectors.where(_usable(F.col("embedding"))).select("id", "embedding"), centroids)
        while True:
            now = self.manifest()
            both = {k: now["rows"].get(k, 0) + rows.get(k, 0) for k in now["rows"] | rows}
            far = {k: max(now["reach"].get(k, 0.0), reach.get(k, 0.0)) for k in now["reach"] | reach}
            try:
                return self.commit(now | {"version": now["version"] + 1, "segments": [*now["segments"], segment] if rows else now["segments"], "rows": both, "reach": far})
            except Conflict:
                continue

    def _segment(self, usable: DataFrame, centroids: np.ndarray) -> tuple[str, dict[str, int], dict[str, float]]:
        """Writes a segment; how many rows each list has in it, and how far from its centroid the furthest is, as an angle."""
        d = centroids.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    near, angle = _nearest(_unit(batch.column("embedding")), centroids)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(angle)], ["id", "embedding", "list", "angle"])

        kinds = dict(usable.dtypes)
        rows = usable.where(F.size("embedding") == d).mapInArrow(assign, f"id {kinds['id']}, embedding {kinds['embedding']}, list int, angle double")
        name = f"segments/segment={uuid.uuid4().hex}"
        rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")))
        each = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("far"))
        files = F.ceil(F.col("n") / F.lit(self.part))
        rows.join(each.select("list", files.alias("files")), "list").repartition("list", F.pmod(F.col("part"), F.col("files"))).drop("files", "angle").write.partitionBy("list").parquet(f"{self.path}/{name}")
        got = each.collect()
        return name, {str(r.list): r.n for r in got}, {str(r.list): r.far for r in got}

    def _rows(self, manifest: dict, lists: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{s}" for s in manifest["segments"]]
        rows = self.spark.read.option("basePath", f"{self.path}/segments").parquet(*[f"{p}" for p in paths])
        return rows if lists is None else rows.where(F.col("list").isin(lists))

    def rows(self) -> DataFrame:
        """All that is indexed: id, embedding, list."""
        return self._rows(self.manifest()).select("id", "embedding", "list")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, skip_self: bool = False) -> DataFrame:
        """(query_id, id, similarity): for each of queries (query_id, embedding) the k nearest by cosine in double precision, of equal ones the smallest ids.

        Looked at are the probes lists whose centroids are nearest. exact: also every list in which a vector could be as near as the worst of
        these, going by how far the list reaches, so the answer is that of a whole scan. Only folders of lists that some query looks into are read;
        their numbers, at most one for each list, come to the driver. skip_self: a row with the query's id isn't among its answers.
        """
        now = self.manifest()
        if not now["segments"]:
            raise ValueError("the index is empty")
        centroids = self._centroids(now)
        known = np.array([now["rows"].get(str(c), 0) > 0 for c in range(len(centroids))])
        asked = cut(queries.where(_usable(F.col("embedding")) & (F.size("embedding") == centroids.shape[1])).select("query_id", "embedding"))
        first = cut(self._look(now, asked.mapInArrow(_probing(centroids, known, probes), _asked(asked)), k, skip_self))
        if not exact:
            return first
        far = np.array([now["reach"].get(str(c), 0.0) for c in range(len(centroids))])
        worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("worst"))
        bound = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-2.0))
        more = asked.join(worst, "query_id", "left").select("query_id", "embedding", bound.alias("worst"))
        rest = self._look(now, more.mapInArrow(_probing(centroids, known, probes, far), _asked(asked)), k, skip_self)
        return _ranked(first.unionByName(rest), k)

    def _look(self, now: dict, asked: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """The k nearest of each query in the lists that asked (query_id, embedding, list) names."""
        asked = cut(asked)
        lists = [r.list for r in asked.select("list").distinct().collect()]
        sizes = self.spark.createDataFrame([(c, max(1, -(-now["rows"][str(c)] // self.part))) for c in lists], "list int, parts int")
        rows = self._rows(now, lists).join(F.broadcast(sizes), "list").select("list", F.pmod("part", "parts").alias("p"), "id", "embedding", F.lit(None).cast("bigint").alias("block"))
        many = asked.groupBy("list").agg((F.count("*") / 4096).cast("bigint").alias("_blocks"))
        blocks = many.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks"))))
        left = asked.join(many, "list").join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.pmod(F.xxhash64("query_id"), F.col("_blocks") + 1).alias("block"), "query_id", "embedding")
        right = rows.drop("block").join(blocks.select("list", "block"), "list")
        kinds = dict(rows.dtypes) | dict(asked.dtypes)

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
            x, y, ids = _unit(a["embedding"]), _unit(b["embedding"]), b["id"].to_numpy()
            out = []
            for at in range(0, len(x), 256):
                s = x[at : at + 256] @ y.T
                own = a["query_id"].to_numpy()[at : at + 256]
                if skip_self:
                    s = np.where(own[:, None] == ids[None, :], -np.inf, s)
                n = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - n, axis=1)[:, -n] - 1e-9
                q, r = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                # rounded, so that equal vectors tie whichever block they are in
                out.append(_top(pd.DataFrame({"query_id": own[q], "id": ids[r], "similarity": np.round(s[q, r], 12)}), k))
            return pd.concat(out)

        keys = ["list", "p", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
        return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def _asked(asked: DataFrame) -> str:
    kinds = dict(asked.dtypes)
    return f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, list int"


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the angle to it."""
    near, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ centroids.T
        near[at : at + 1024], best[at : at + 1024] = s.argmax(axis=1), s.max(axis=1)
    return near, np.arccos(np.clip(best, -1, 1))


def _summing(centroids: np.ndarray):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape)
        for batch in batches:
            if len(batch):
                x = _unit(batch.column("embedding"))
                near, _ = _nearest(x, centroids)
                np.add.at(sums, near, x)
                n += np.bincount(near, minlength=len(centroids))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"list": pa.array(met, pa.int32()), "n": pa.array(n[met]), "total": pa.array(list(sums[met]), pa.list_(pa.float64()))})

    return total


def _probing(centroids: np.ndarray, known: np.ndarray, probes: int, far: np.ndarray | None = None):
    """Each query once for each list that it looks into: of those with rows the nearest, or with far the others that may have something as near as worst."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.where(known, _unit(batch.column("embedding")) @ centroids.T, -np.inf)
            n = min(probes, int(known.sum()))
            looked = np.zeros(s.shape, dtype=bool)
            np.put_along_axis(looked, np.argsort(-s, axis=1, kind="stable")[:, :n], True, axis=1)
            if far is not None:
                reach = np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - far, 0)) + 1e-9
                looked = known & ~looked & (reach >= batch.column("worst").to_numpy()[:, None])
            row, at = np.nonzero(looked)
            taken = batch.select(["query_id", "embedding"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32())], ["query_id", "embedding", "list"])

    return probe

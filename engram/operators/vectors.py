"""Search by cosine similarity with one vector, and recall of memories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.values import age_days, recall_score, recency_blend
from engram.operators.batches import small
from engram.operators.filters import newest, scope_matches


def similarity(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a query vector in double precision, by Arrow batches. Null, empty and zero vectors and those of another length give null."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def cosine(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == len(q)).to_numpy(dtype=bool)
        out = np.full(len(vectors), np.nan)
        if fits.any() and norm:
            x = np.stack(vectors[fits].to_numpy()).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[fits] = x @ q / (np.linalg.norm(x, axis=1) * norm)
        return pd.Series(out)

    found = cosine(vector)
    return F.when(~F.isnan(found), found)


def match_thoughts(rows: DataFrame, query: Sequence[float], threshold: float = 0.7, count: int = 10, where: Column | None = None, inclusive: bool = False) -> DataFrame:
    """The rows most like the query: similarity over the threshold (or at it, if inclusive), filtered before the vectors are looked at."""
    rows = rows if where is None else rows.where(where)
    scored = rows.withColumn("similarity", similarity(F.col("embedding"), query))
    over = F.col("similarity") >= threshold if inclusive else F.col("similarity") > threshold
    return scored.where(over).orderBy(F.desc("similarity"), "id").limit(count)


def match_recent(rows: DataFrame, query: Sequence[float], as_of: str, threshold: float = 0.7, count: int = 10, weight: float = 0.0, scale_days: float = 90.0) -> DataFrame:
    """As match_thoughts with similarity at the threshold or more, in order of the blend of similarity and age."""
    scored = rows.withColumn("similarity", similarity(F.col("embedding"), query)).where(F.col("similarity") >= threshold)
    return scored.withColumn("score", recency_blend(F.col("similarity"), age_days(F.col("created_at"), as_of), weight, scale_days)).orderBy(F.desc("score"), "id").limit(max(1, min(count, 200)))


def recall(vectors: DataFrame, memories: DataFrame, query: Sequence[float], workspace: str, project: str | None = None, items: int = 10, threshold: float = 0.25, **scope) -> DataFrame:
    """Memories of a workspace whose thoughts are hits, those in scope by recall score. If nothing is a hit, the newest 100 memories count with similarity 0."""
    hits = match_thoughts(vectors, query, threshold, max(4 * items, 20)).select(F.col("id").alias("thought_id"), "similarity")
    near = memories.where(F.col("workspace_id") == workspace).join(hits, "thought_id")
    near = newest(near, 100, key="memory_id")
    none = hits.agg((F.count("*") == 0).alias("none"))
    fallback = newest(memories.where(F.col("workspace_id") == workspace), 100, key="memory_id").withColumn("similarity", F.lit(0.0)).crossJoin(F.broadcast(none)).where("none").drop("none")
    rows = near.unionByName(fallback.select(*near.columns)).where(scope_matches(workspace, project, **scope))
    return rows.withColumn("score", recall_score(F.col("similarity"))).orderBy(F.desc("score"), "memory_id").limit(items)


def similar_pairs(queries: DataFrame, rows: DataFrame, threshold: float, count: int, block: int = 4096) -> DataFrame:
    """For each query (query_id, embedding) the rows (id, embedding) most like it: one block of queries against all rows.

    The queries are broadcast, so they have to be few: over block of them ValueError is raised. nearest_pairs takes any number.
    """
    some = queries.select("query_id", "embedding").where("embedding IS NOT NULL").limit(block + 1).collect()
    if len(some) > block:
        raise ValueError(f"more than {block} queries")
    ids = np.array([r.query_id for r in some], dtype=np.int64)
    q = np.array([r.embedding for r in some], dtype=np.float64)
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(some) else q
    shared = queries.sparkSession.sparkContext.broadcast((ids, q))

    def compare(batches):
        ids, q = shared.value
        for batch in batches:
            batch = batch[batch["embedding"].map(lambda v: v is not None and q.ndim == 2 and len(v) == q.shape[1])]
            if not len(batch):
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            near = x @ q.T / np.linalg.norm(x, axis=1, keepdims=True)
            a, b = np.nonzero(near > threshold)
            yield pd.DataFrame({"query_id": ids[b], "id": batch["id"].to_numpy()[a], "similarity": near[a, b]})

    from pyspark.sql import Window

    pairs = rows.select("id", "embedding").mapInPandas(compare, "query_id long, id long, similarity double").where("query_id <> id")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("_n", n).where(F.col("_n") <= count).drop("_n")


def nearest_pairs(queries: DataFrame, rows: DataFrame, threshold: float, count: int, block: int = 1024) -> DataFrame:
    """As similar_pairs for any number of queries: blocks of queries meet blocks of rows in the tasks; only what is small enough is broadcast by Spark.

    A block of either side is one row of a join; of each pair of blocks a query keeps its count best rows.
    """
    from pyspark.sql import Window

    def packed(batches):
        for batch in batches:
            batch = batch[batch["embedding"].map(lambda v: v is not None and len(v) > 0)]
            for dims, some in batch.groupby(batch["embedding"].map(len)):
                for k in range(0, len(some), block):
                    part = some.iloc[k : k + block]
                    yield pd.DataFrame({"ids": [part["id"].to_numpy(dtype=np.int64).tobytes()], "dims": [dims], "vectors": [np.stack(part["embedding"].to_numpy()).astype(np.float64).tobytes()]})

    def compare(batches):
        for batch in batches:
            # compared here: as a condition of the join it would send all blocks to one task
            for r in batch[batch["query_dims"] == batch["dims"]].itertuples(index=False):
                q, x = (np.frombuffer(v).reshape(-1, r.dims) for v in (r.query_vectors, r.vectors))
                query, row = np.frombuffer(r.query_ids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ x.T / np.linalg.norm(x, axis=1)
                a, b = np.nonzero((near > threshold) & (query[:, None] != row))
                value = near[a, b]
                order = np.lexsort((row[b], -value, a))
                a, b, value = a[order], b[order], value[order]
                # the place of each among the rows of its query
                best = np.arange(len(a)) - np.searchsorted(a, a) < count
                yield pd.DataFrame({"query_id": query[a[best]], "id": row[b[best]], "similarity": value[best]})

    pack = lambda df, c: df.select(F.col(c).cast("long").alias("id"), "embedding").mapInPandas(packed, "ids binary, dims int, vectors binary")
    left = pack(queries, "query_id").select(F.col("ids").alias("query_ids"), F.col("dims").alias("query_dims"), F.col("vectors").alias("query_vectors"))
    pairs = small(left.crossJoin(pack(rows, "id"))).mapInPandas(compare, "query_id long, id long, similarity double")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("_n", n).where(F.col("_n") <= count).drop("_n")


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic vector of a text without a model: its tokens' hashes as signs, summed by cell and scaled to length 1."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)

    @F.pandas_udf("array<float>")
    def embed(lists: pd.Series) -> pd.Series:
        import zlib

        out = []
        for words in lists:
            v = np.zeros(dims, dtype=np.float64)
            for w in words:
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed(tokens)

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators.cut import folder
from engram.operators.vector_index import VectorIndex

KIND = "id long, embedding array<float>"


def clustered(seed, n=4000, d=16, clusters=60):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, d))
    weight = np.full(clusters, 0.67 / (clusters - 1))
    weight[0] = 0.33  # a third in one place
    return (middle[r.choice(clusters, n, p=weight)] + 0.3 * r.normal(size=(n, d))).astype(np.float32)


def nearest(rows, queries, k, skip=True):
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in queries:
        s = np.round(x @ (np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))), 12)
        order = [j for j in np.lexsort((ids, -s)) if not skip or ids[j] != q][:k]
        out[q] = [int(ids[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, -r.similarity, r.id)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_recall_at_a_share_of_rows_and_exact_search(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(1))]
    rows += [(9000 + k, rows[k][1]) for k in range(5)]
    index = VectorIndex(spark, folder(spark, "index"), part=500)
    old, new = rows[:3000], rows[3000:]
    index.build(spark.createDataFrame(old, KIND).repartition(4), sample=1500)
    centroids = index.manifest()["centroids"]
    index.append(spark.createDataFrame(new, KIND))
    assert index.manifest()["centroids"] == centroids and len(index.manifest()["segments"]) == 2
    assert sorted(r.id for r in index.rows().collect()) == sorted(i for i, _ in rows)
    queries = [x for x in rows if x[0] % 50 == 0]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    want = nearest(rows, queries, 10)
    got = found(index.search(asked, 10, probes=6, skip_self=True))
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95
    sizes, middle = index.manifest()["rows"], index._centroids(index.manifest())
    looked = np.argsort(-(np.array([v for _, v in queries]) @ middle.T), axis=1)[:, :6]
    share = np.mean([sum(sizes.get(str(c), 0) for c in row) for row in looked]) / len(rows)
    assert share < 0.35, share  # a third of all rows is one cluster
    assert found(index.search(asked, 10, probes=2, exact=True, skip_self=True)) == want
    assert found(index.search(asked.limit(3), 4000 + 99, probes=1, exact=True)) == {q: v for q, v in nearest(rows, queries, 4099, skip=False).items() if q in {r.query_id for r in asked.limit(3).collect()}}


def test_only_probed_lists_are_read(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(2, 2000))]
    index = VectorIndex(spark, folder(spark, "index"))
    index.build(spark.createDataFrame(rows, KIND), lists=40)
    now = index.manifest()
    some = index._rows(now, [3, 7])
    assert {f.split("list=")[1].split("/")[0] for f in some.inputFiles()} <= {str(c) for c in range(40)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "3,7" in plan.replace(" ", "")


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 1.0, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 0.1])]
    index = VectorIndex(spark, folder(spark, "index"))
    with pytest.raises(ValueError, match="empty"):
        index.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>"))
    with pytest.raises(ValueError, match="no vector"):
        index.build(spark.createDataFrame(rows, KIND).where("id = 3"))
    index.build(spark.createDataFrame(rows, KIND))
    index.append(spark.createDataFrame(rows, KIND).limit(0))
    asked = spark.createDataFrame([(10, [3.0, 0.0]), (11, None), (12, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert found(index.search(asked.where("query_id > 9"), 2, exact=True)) == {10: [1, 7]}
    assert index.search(asked.limit(0), 2, exact=True).count() == 0
    assert index.rows().where(F.col("id").isNull()).count() == 1

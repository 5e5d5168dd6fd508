import numpy as np
from pyspark.sql import functions as F

from engram.operators.vectors import nearest_pairs
from engram.plans import all_queries


def test_any_number_of_queries_against_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(600, 5)).astype(np.float32)
    vectors[40] = vectors[90] = vectors[7]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = nearest_pairs(df.select(F.col("id").alias("query_id"), "embedding"), df, 0.5, 3, block=16).collect()
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for k, near in enumerate(x @ x.T):
        best = sorted((-round(s, 9), j) for j, s in enumerate(near) if j != k and s > 0.5)[:3]
        want[k] = [(j, -s) for s, j in best]
    found = {}
    for p in sorted(got, key=lambda p: (p.query_id, -round(p.similarity, 9), p.id)):
        found.setdefault(p.query_id, []).append((p.id, round(p.similarity, 9)))
    assert found == {k: v for k, v in want.items() if v}
    assert nearest_pairs(df.select(F.col("id").alias("query_id"), "embedding").limit(0), df, 0.5, 3).count() == 0


def test_batch_search_takes_more_queries_than_a_block(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(5000, 2)).tolist()
    spark.createDataFrame([(50 * k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = all_queries()[0]["v10_batch_search"](spark, str(tmp_path))
    assert got.select("query_id").distinct().count() == 5000

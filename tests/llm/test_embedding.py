import math
import random

import numpy as np

from engram.llm import embedding
from engram.llm.embedding import _buckets, bands_for, decode, encode, near_vectors, slack


def brute(rows, least=0.98):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = {i: (k, np.array(v) / np.linalg.norm(v)) for i, v, k in rows if i is not None and k is not None and ok(v)}
    root = {i: i for i, _, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, links[i], find(i), find(i) == i) for i in root)


def vectors(seed, d=64):
    r = np.random.default_rng(seed)
    near = lambda v, e: v + e * np.linalg.norm(v) / math.sqrt(d) * r.normal(size=d)
    out = [r.normal(size=d) for _ in range(300)]
    for n, e in ((2, 0.1), (3, 0.15), (5, 0.19), (60, 0.1), (200, 0.14)):
        base = r.normal(size=d)
        out += [near(base, e) for _ in range(n)]
    chain = [r.normal(size=d)]
    for _ in range(30):
        chain.append(near(chain[-1], 0.15))
    out += chain + [out[0]] * 40 + [out[7] * 3.5]
    rows = [(v.astype(np.float32).tolist(), int(r.integers(2)) if r.random() < 0.3 else 1) for v in out]
    rows += [(None, 1), ([0.0] * d, 1), ([float("nan")] + [1.0] * (d - 1), 1), ([float("inf")] * d, 1), ([None] * d, 1), ([], 1), (rows[0][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e-30] * 3, 1), ([1e-30] * 3, 1)]
    random.Random(seed).shuffle(rows)
    return [(k, *row) for k, row in enumerate(rows)]


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows)
    monkeypatch.setattr(embedding, "LIMIT", 40)
    monkeypatch.setattr(embedding, "BLOCK", 30)
    monkeypatch.setattr(embedding, "bands_for", lambda least, miss, most, f=embedding.bands_for: f(least, 1e-9, 10**7))
    assert sorted(map(tuple, near_vectors(df, id_col="vec_id").collect())) == brute(rows)


def test_few_pairs_miss_all_buckets():
    """Pairs at the least similarity, for labels of up to a billion vectors: under the stated share but for chance of the sample."""
    r, n = np.random.default_rng(3), 20_000
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for d in (4, 8, 64, 384):
        x = unit(r.normal(size=(n, d)))
        side = r.normal(size=x.shape)
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * unit(side - (side * x).sum(axis=1, keepdims=True) * x)
        for most in (10**5, 10**7, 10**9):
            bands, width = bands_for(0.98, 0.001, most)
            missed = ~(_buckets(x, np.zeros(n, dtype=np.int64), bands, width) == _buckets(y, np.zeros(n, dtype=np.int64), bands, width)).any(axis=1)
            assert missed.mean() <= 0.001 + 3 * math.sqrt(0.001 / n), (d, most)


def test_repeated_rows_nulls_and_empty_tables(spark):
    v, w = [0.5, 1.0, 0.0, -2.0], [0.5, 1.01, 0.0, -2.0]
    df = spark.createDataFrame([(4, v, 1, 0), (4, v, 1, 1), (9, w, 1, 2), (None, v, 1, 3), (7, v, None, 4)], "vec_id long, embedding array<float>, label int, vec int")
    got = sorted(map(tuple, near_vectors(df).collect()), key=str)
    assert got == sorted([(4, 1, 4, True), (4, 1, 4, True), (9, 1, 4, False), (None, 0, None, None), (7, 0, 7, True)], key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.normal(size=(4000, 64)))
    side = r.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    for cos in (0.98, 0.5, 0.0):
        y = cos * x + math.sqrt(1 - cos * cos) * side
        (left, _), (_, right) = (decode(*encode(z), 64) for z in (x, y))
        error = (left * right).sum(axis=1) - cos
        assert abs(error.mean()) < 0.005
        if cos == 0.98:
            assert (error < -slack(encode(x)[1], 64, 0.98, 5.0)).sum() == 0

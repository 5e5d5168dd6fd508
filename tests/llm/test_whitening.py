import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm.queries import QUERIES
from engram.llm.whitening import Sums, triangular_factor, whiten

COLUMNS = ["component", "deviation", "explained", "identity_error", "n", "vec_id", "whitened"]


def brute(vectors, most=32):
    """Ids, components, variances, their shares and deviations by the covariance matrix."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = ((x * n - s) / n).astype(np.float64)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return centred, e[:most], v[:, :most], e[:most] / e.sum(), [int(sum(d * d for d in row)) for row in x * n - s]


def table(rows):
    """vec_id -> (deviation, whitened by component)."""
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, (r.deviation, {}))[1][r.component] = r.whitened
    return out


def agrees(rows, ids, vectors, most=32):
    centred, e, v, share, deviation = brute(vectors, most)
    got = table(rows)
    assert sorted(got) == sorted(ids)
    w = np.array([[got[i][1][k + 1] for k in range(len(e))] for i in ids])
    want = centred @ v / np.sqrt(e)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-6
    assert [got[i][0] for i in ids] == deviation
    assert {r.n for r in rows} == {len(ids)} and len({r.identity_error for r in rows}) == 1
    assert {r.component: r.explained for r in rows} == pytest.approx({k + 1: x for k, x in enumerate(share)}, rel=1e-9)
    assert rows[0].identity_error < 1e-9
    assert np.abs(w.T @ w / len(w) - np.eye(len(e))).max() < 1e-9


def test_against_covariance(spark):
    r = np.random.default_rng(1)
    good = (r.normal(size=(500, 40)) * np.linspace(0.2, 3, 40) + 5).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(good)]
    odd = [(900, None), (901, [float("nan")] + [1.0] * 39), (902, [float("-inf")] * 40), (903, [None] * 40), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("x", "id", "w", "k", "n", "label")})
    for parts in (1, 7):
        got = whiten(df.repartition(parts)).collect()
        agrees(got, range(500), good)
    assert sorted(got[0].asDict()) == COLUMNS


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    agrees(QUERIES["op12_embedding_whitening"](spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_small_spreads_beside_large_ones(spark):
    """Standard deviations of a million and of one: a covariance in double precision would be all rounding in the small ones."""
    r = np.random.default_rng(2)
    turn = np.linalg.qr(r.normal(size=(6, 6)))[0]
    rows = (r.normal(size=(3000, 6)) * [1e6, 1e6, 1e3, 10, 1, 1]) @ turn
    got = whiten(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5))
    w = np.array([list(x[1].values()) for x in table(got.collect()).values()])
    assert w.shape == (3000, 6) and got.first().identity_error < 1e-6
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-6


def test_few_rows_ties_repeats_and_empty_tables(spark):
    make = lambda rows: whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0 and make([(1, [1.0, 2.0])]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    got = make([(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (None, [3.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0])]).collect()
    assert sorted((str(r.vec_id), r.component, round(r.whitened, 9), r.deviation) for r in got) == [("1", 1, -1.0, 256**2), ("1", 1, -1.0, 256**2), ("4", 1, 1.0, 256**2), ("None", 1, 1.0, 256**2)]
    ties = make([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])]).collect()
    assert len(ties) == 8 and {round(r.explained, 9) for r in ties} == {0.5}


def test_huge_entries_and_exact_deviations(spark):
    got = whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 9.5])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None} and {r.n for r in got} == {3}
    s = Sums(3, [3 * 10**6 + 5, -7])
    x = np.array([[10**6, 4], [2**30 + 10**6, 1], [2**31, 2**31], [10**6 + 1, -(2**30)]])
    want = [sum((3 * int(v) - t) ** 2 for v, t in zip(row, s.s, strict=True)) for row in x]
    assert s.deviation(x) == [v if v < 2**63 else None for v in want]


def test_factor_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 1000, size=(400, 9))
    s = Sums(400, x.sum(axis=0).tolist())
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    whole = s.centred(x)
    for parts in (1, 3, 40):
        f = triangular_factor(df.repartition(parts), 9, s)
        assert np.abs(f.T @ f - whole.T @ whole).max() < 1e-6

"""Embedding whitening by a tall and skinny QR: principal components of vectors without a covariance matrix.

Entries are made whole numbers, so the sums by which rows are centred are exact whatever the order of rows. Each
partition folds its centred rows into a triangular factor, batch by batch; factors are merged by fours until one is left, and
its singular values and right vectors are those of all rows. Squaring the data, which loses half of the digits, never happens.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.shared import discard, materialise

#: An entry c becomes floor(SCALE c) + SHIFT; what would be over LARGEST either way is LARGEST.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 42
#: Factors that are merged at once.
MERGED = 4
#: Components whose standard deviation is under this share of the first one's are no directions but rounding.
RANK = 1e-9


def whole_numbers(vector: Column) -> Column:
    """The vector's entries as whole numbers; null where the vector is null, empty or has entries that are null or not finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    most = F.lit(float(LARGEST))
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, most), -most)).cast("long") + SHIFT)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd, x)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


@dataclass
class Sums:
    """Rows, and the exact sum of each dimension."""

    n: int
    s: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole numbers above n where they fit a long, so that only the division rounds."""
        if self.fits(x):
            return (x * self.n - np.array(self.s, dtype=np.int64)) / self.n
        return np.array([[float(Fraction(v * self.n - s, self.n)) for v, s in zip(row, self.s, strict=True)] for row in x.tolist()])

    def fits(self, x: np.ndarray) -> bool:
        return max(self.n * int(np.abs(x).max(initial=0)), *map(abs, self.s)) < 1 << 62

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - s)^2, exact; null where that is no long. Only rows near that limit are done without numpy."""
        if not self.fits(x):
            return [_long(sum((v * self.n - s) ** 2 for v, s in zip(row, self.s, strict=True))) for row in x.tolist()]
        d = x * self.n - np.array(self.s, dtype=np.int64)
        about = (d.astype(np.float64) ** 2).sum(axis=1)
        small = about < 2.0**62.9
        d[~small] = 0
        out = (d * d).sum(axis=1).tolist()
        for k in np.flatnonzero(~small):
            out[k] = None if about[k] > 2.0**63.1 else _long(sum((v * self.n - s) ** 2 for v, s in zip(x[k].tolist(), self.s, strict=True)))
        return out


def _long(v: int) -> int | None:
    return v if v < 1 << 63 else None


def exact_sums(rows: DataFrame, d: int) -> Sums:
    """Of rows (x) with d entries each: a task sends a number for each dimension, the driver gets one for each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), 1 << 16):
                part = _matrix(batch.slice(at, 1 << 16))
                n += len(part)
                s += part.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([str(v) for v in s])})

    got = rows.select("x").mapInArrow(add, "k int, n long, s string").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.k: r for r in got}
    return Sums(by[0].n if by else 0, [int(by[k].s) for k in range(d)] if by else [])


def _reduced(partials: DataFrame, merge: Callable[[list[bytes]], bytes], at_once: int) -> bytes | None:
    """One value out of partials (node, value), nodes from 0: merged at_once by one, round by round, none where there is no row.

    Partials are written, so a lost executor costs the tasks of one round. The driver gets the last value only.
    """

    def meet(group: pa.Table) -> pa.Table:
        return pa.table({"node": pa.array([group["node"][0].as_py() // at_once], pa.int64()), "value": pa.array([merge(group["value"].to_pylist())], pa.binary())})

    nodes = materialise(partials, "partials")
    last = nodes.agg(F.max("node")).first()[0] or 0
    while last > 0:
        above = materialise(nodes.groupBy(F.floor(F.col("node") / at_once).alias("above")).applyInArrow(meet, "node long, value binary"), "partials")
        discard(nodes)
        nodes, last = above, last // at_once
    first = nodes.select("value").first()
    discard(nodes)
    return None if first is None else bytes(first[0])


def _partial(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "value": pa.array([value], pa.binary())})


def _packed(r: np.ndarray) -> bytes:
    """The upper triangle of a square factor."""
    return r[np.triu_indices(len(r))].tobytes()


def _unpacked(data: bytes, d: int) -> np.ndarray:
    r = np.zeros((d, d))
    r[np.triu_indices(d)] = np.frombuffer(data)
    return r


def _folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The square factor of r and rows, one below the other."""
    d = rows.shape[1]
    out = np.linalg.qr(np.concatenate([r, rows]), mode="r")
    return out if len(out) == d else np.concatenate([out, np.zeros((d - len(out), d))])


def triangular_factor(rows: DataFrame, d: int, sums: Sums) -> np.ndarray:
    """The factor R of the centred rows (x), with R'R their scatter; of no rows at all, zeros. The driver gets d (d + 1) / 2 numbers."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, len(batch), step):
                r = _folded(np.zeros((0, d)) if r is None else r, sums.centred(_matrix(batch.slice(at, step))))
        if r is not None:
            yield _partial(_packed(r))

    def merge(values: list[bytes]) -> bytes:
        r = np.zeros((0, d))
        for value in values:
            r = _folded(r, _unpacked(value, d))
        return _packed(r)

    step = max(d, 4096)
    got = _reduced(rows.select("x").mapInArrow(factor, "node long, value binary"), merge, MERGED)
    return np.zeros((d, d)) if got is None else _unpacked(got, d)


def _joined(a: tuple, b: tuple) -> tuple:
    """Rows, mean and scatter around it of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(rows: DataFrame, sums: Sums, basis: np.ndarray) -> float:
    """The largest entry of the covariance of the rows' projections less the identity. Each batch is centred before it is multiplied."""
    k = basis.shape[1]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                w = sums.centred(_matrix(batch.slice(at, 4096))) @ basis
                mean = w.mean(axis=0)
                own = (len(w), mean, (w - mean).T @ (w - mean))
                total = own if total is None else _joined(total, own)
        if total is not None:
            yield _partial(packed(total))

    packed = lambda t: np.concatenate([[float(t[0])], t[1], t[2].ravel()]).tobytes()
    unpacked = lambda v: (v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k))
    merge = lambda values: packed(reduce(_joined, (unpacked(np.frombuffer(v)) for v in values)))
    n, _, total = unpacked(np.frombuffer(_reduced(rows.select("x").mapInArrow(scatter, "node long, value binary"), merge, 64)))
    return float(np.abs(total / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries go, and so do those of another length than most have (of equally frequent
    lengths the smallest). Entries are whole_numbers. n: vectors left; deviation: sum over dimensions of (n x - sum)^2, exact, null
    where that is no long. Components are the right singular vectors of the centred rows by falling singular value, numbered from 1, with
    their largest entry positive; whitened is the projection over the component's standard deviation, explained the component's share of the whole
    variance. There are no more components than directions in which the vectors differ: one vector, equal vectors or an empty table give no rows.
    identity_error: what the whitened covariance is off the identity, measured over all rows. Ids may repeat or be null; other columns aren't read.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = sizes.d if sizes else 1
    rows = rows.where(F.size("x") == d)
    sums = exact_sums(rows, d)
    r = triangular_factor(rows, d, sums)
    _, spread, right = np.linalg.svd(r)
    k = int((spread[:components] > RANK * max(float(spread[0]), 1e-6)).sum())
    right = right[:k] * np.sign(right[np.arange(k), np.abs(right[:k]).argmax(axis=1)])[:, None]
    n = max(sums.n, 1)
    basis = right.T * (math.sqrt(n) / spread[:k])
    error = identity_error(rows, sums, basis) if k else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part)
                w = sums.centred(x) @ basis
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sums.deviation(x), pa.int64()), flat], ["id", "deviation", "w"])

    done = rows.where(F.lit(k > 0)).mapInArrow(project, f"id {kind}, deviation long, w array<double>")
    share = F.array(*(F.lit(float(v)) for v in (spread**2 / max(float((spread**2).sum()), 1e-300))[: max(k, 1)]))
    each = done.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(sums.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error")
    )

"""Embedding near-dedup: randomised-rotation binary codes say which pairs of vectors have to be compared exactly.

A unit vector x of d dimensions is turned by K random rotations and kept as the K d signs of its coordinates, with K
correction factors: f_k, the inner product of the turned vector and its code as a unit vector. Turned back and divided by
f_k, a code is x plus an error at right angles to x, of squared length 1 / f_k^2 - 1 and of mean 0 over rotations. So the inner product of
x by rotation k and y by rotation l is an unbiased estimate of x . y for k <> l; the estimate is the mean of all these.
Its variance follows from the factors, which gives the bound under which a pair can't be similar enough.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.bytetext import U, mixed
from engram.llm.shared import components, materialise

ROTATIONS = 4
#: Vectors of a bucket or block that are compared at once; larger ones are compared by pairs of parts.
LIMIT = 2048
BLOCK = 1024
#: A group has so many blocks, until they are as large as BLOCK.
BLOCKS = 8
#: The sketch of bucket sizes has a cell for each so many entries, between these bounds.
PER_CELL, LEAST_CELLS, MOST_CELLS = 64, 1 << 12, 1 << 22
SKETCH_PARTS = 16
SALTS = 64


def _rotation(d: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([d, 7, k]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))  # uniform over rotations and reflections


@lru_cache(maxsize=8)
def rotations(d: int) -> np.ndarray:
    return np.stack([_rotation(d, k) for k in range(ROTATIONS)])


@lru_cache(maxsize=8)
def band_directions(d: int, bands: int, width: int) -> np.ndarray:
    """d x (bands width): the directions of the bands' bits, of rotations of their own.

    There are as many rotations as the bits need and as a band is wide, and a band takes each of its bits from another one.
    So no bit serves twice, the bits of a band are independent, and those of different bands at worst at right angles.
    """
    bits = bands * width
    count = max(width, -(-bits // d))
    out = np.zeros((d, bits))
    for k in range(count):
        mine = np.arange(k, bits, count)
        out[:, mine] = _rotation(d, ROTATIONS + k)[:, : len(mine)]
    return out


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x K d bits as booleans) and correction factors (rows x K) of unit vectors."""
    d = x.shape[1]
    turned = np.einsum("nd,kde->nke", x, rotations(d).transpose(0, 2, 1))
    return (turned > 0).reshape(len(x), -1), (np.abs(turned).sum(axis=2) / math.sqrt(d)).astype(np.float32)


def decode(bits: np.ndarray, factors: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of which the rows' inner products are the estimates."""
    code = (2.0 * bits.reshape(len(bits), ROTATIONS, d) - 1) / math.sqrt(d) / factors[:, :, None]
    back = np.einsum("nke,ked->nkd", code, rotations(d)).astype(np.float32)
    whole, each = back.sum(axis=1), back.reshape(len(bits), -1)
    return np.concatenate([whole, -each], axis=1) / np.float32(ROTATIONS * (ROTATIONS - 1)), np.concatenate([whole, each], axis=1)


def slack(factors: np.ndarray, d: int, least: float, sigmas: float) -> float:
    """So much may an estimate be under the inner product of a pair that is similar enough, for any pair of these vectors."""
    a = float((1 / factors.astype(np.float64) ** 2 - 1).mean(axis=1).max())
    n = max(d - 1, 1)
    return sigmas * math.sqrt(2 * a * (1 - least * least) / (ROTATIONS * n) + a * a / (n * ROTATIONS * (ROTATIONS - 1)))


def joined(left: np.ndarray, right: np.ndarray, least: float, chunk: int = 256) -> np.ndarray:
    """For each row the first row of its component, where rows with an inner product of least or more are linked.

    What has been reached isn't compared again, so a dense group costs its size and not the square of it.
    """
    n = len(left)
    first = np.full(n, -1)
    open_ = np.arange(n)
    while len(open_):
        seed, queue = int(open_[0]), open_[:1]
        first[seed] = seed
        open_ = open_[1:]
        while len(queue) and len(open_):
            near = (left[queue[:chunk]] @ right[open_].T >= least).any(axis=0)
            queue = np.concatenate([queue[chunk:], open_[near]])
            first[open_[near]] = seed
            open_ = open_[~near]
    return first


def _joined(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """As joined; the rows of small tables that are linked with none are found by one product."""
    n = len(left)
    if n > LIMIT // 4:
        return joined(left, right, least)
    near = left @ right.T >= least
    np.fill_diagonal(near, False)
    busy = np.flatnonzero(near.any(axis=1) | near.any(axis=0))
    first = np.arange(n)
    if len(busy):
        first[busy] = busy[joined(left[busy], right[busy], least)]
    return first


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the coordinates neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: int):
    """(length, rows) of a batch."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def _buckets(x: np.ndarray, label: np.ndarray, bands: int, width: int) -> np.ndarray:
    """Rows x bands of unit vectors: hashes of label, length, band and the band's bits."""
    d = x.shape[1]
    out = np.zeros((len(x), bands), dtype=U)
    bits = (x @ band_directions(d, bands, width) > 0).astype(U) if width else np.zeros((len(x), 0), dtype=U)
    with np.errstate(over="ignore"):
        own = mixed(label.view(U) * U(0x9E3779B97F4A7C15) + U(d))
        for k in range(bands):
            value = bits[:, k * width : (k + 1) * width] @ (U(1) << np.arange(width, dtype=U)) if width else np.zeros(len(x), dtype=U)
            out[:, k] = mixed(own + mixed(value * U(0xC2B2AE3D27D4EB4F) + U(k)))
    return out


def bands_for(least: float, miss: float, most: int) -> tuple[int, int]:
    """(bands, width): buckets of some 128 of the largest label's most vectors, in so many bands, and one more, that a pair at least misses all with probability miss."""
    same = 1 - math.acos(least) / math.pi  # of two signs at the least similarity
    width = min(24, max(0, math.ceil(math.log2(max(most, 1) / 128))))
    return (math.ceil(math.log(miss) / math.log(1 - same**width)) + 1 if width else 1), width


def _entries(batch: pa.RecordBatch, bands: int, width: int, codes: bool = True):
    """(length, ids, bits, factors, buckets) of a batch (vec, label, embedding), by length."""
    ids, label = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    for d, rows in _by_length(batch, 2):
        x = _unit(_matrix(batch.column(2).take(pa.array(rows))))
        bits, factors = encode(x) if codes else (None, None)
        yield d, ids[rows], bits, factors, _buckets(x, label[rows], bands, width)


def _cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & U(cells - 1)).astype(np.int64), (h >> U(40)).astype(np.int64) & (cells - 1)


def bucket_sketch(vectors: DataFrame, bands: int, width: int, cells: int) -> np.ndarray:
    """Count-min sketch, 2 x cells, of how many vectors each bucket has: never under the number, and of a bounded size."""

    def count(batches):
        total = np.zeros((2, cells), dtype=np.uint32)
        for batch in batches:
            for *_, buckets in _entries(batch, bands, width, codes=False):
                for row, cell in zip(total, _cells(buckets.ravel(), cells), strict=True):
                    row += np.bincount(cell, minlength=cells).astype(np.uint32)
        parts = np.split(total, SKETCH_PARTS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "block"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), dtype=np.uint32).astype(np.uint64) for b in table.column("block"))
        return pa.table([table.column("part")[:1], pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["part", "block"])

    rows = vectors.mapInArrow(count, "part int, block binary").groupBy("part").applyInArrow(add, "part int, block binary").collect()
    blocks = {r.part: np.frombuffer(r.block, dtype=np.uint32).reshape(2, -1) for r in rows}
    return np.concatenate([blocks[k] for k in range(SKETCH_PARTS)], axis=1) if rows else np.zeros((2, cells), dtype=np.uint32)


def _maybe_links(vectors: DataFrame, least: float, miss: float, sigmas: float, count: int, most: int) -> DataFrame:
    """vectors (vec, label, embedding) -> edges (a, b) that join all vectors between which there may be links."""
    spark = vectors.sparkSession
    bands, width = bands_for(least, miss, most)
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (count * bands // PER_CELL).bit_length()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * bands * 64 // (8 << 20))
    sketch = spark.sparkContext.broadcast(bucket_sketch(vectors, bands, width, cells))

    def send(batches):
        for batch in batches:
            for d, ids, bits, factors, buckets in _entries(batch, bands, width):
                a, b = _cells(buckets, cells)
                parts = -(-np.minimum(sketch.value[0][a], sketch.value[1][b]).astype(np.int64) // LIMIT)
                packed = np.concatenate([np.packbits(bits, axis=1), np.ascontiguousarray(factors).view(np.uint8)], axis=1)
                row = np.repeat(np.arange(len(ids)), parts.sum(axis=1))
                n = parts.ravel()
                key, n = np.repeat(buckets.ravel(), n), np.repeat(n, n)
                other = np.arange(len(key)) - np.repeat(np.cumsum(parts.ravel()) - parts.ravel(), parts.ravel())
                own = (mixed(ids[row].astype(U)) % n.astype(U)).astype(np.int64)
                with np.errstate(over="ignore"):
                    pair = np.minimum(own, other).astype(U) << U(32) | np.maximum(own, other).astype(U)
                    key = np.where(n > 1, mixed(key + mixed(pair + U(1))), key)
                task = (key % U(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                row, key, task = row[order], key[order], task[order]
                cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.zeros(0, dtype=np.int64)
                spans = list(zip(cuts, np.append(cuts[1:], len(task)), strict=True)) if len(cuts) else []
                block = lambda x: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(task[cuts], pa.int32()), pa.array(np.full(len(cuts), d), pa.int32()), block(key), block(ids[row]), block(packed[row])], ["task", "dim", "keys", "ids", "codes"])

    def compare(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        key, ids, codes = (np.concatenate([np.frombuffer(b.as_buffer(), dtype=kind) for b in table.column(c)]) for c, kind in (("keys", U), ("ids", np.int64), ("codes", np.uint8)))
        codes = codes.reshape(len(ids), -1)
        order = np.argsort(key, kind="stable")
        key, ids, codes = key[order], ids[order], codes[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i > 1:
                factors = np.ascontiguousarray(codes[i:j, -4 * ROTATIONS :]).view(np.float32)
                bits = np.unpackbits(codes[i:j, : -4 * ROTATIONS], axis=1, count=ROTATIONS * d)
                first = _joined(*decode(bits, factors, d), least - slack(factors, d, least, sigmas))
                moved = np.flatnonzero(first != np.arange(j - i))
                out_a.append(ids[i + moved])
                out_b.append(ids[i + first[moved]])
        return pa.table([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return vectors.mapInArrow(send, "task int, dim int, keys binary, ids binary, codes binary").groupBy("task", "dim").applyInArrow(compare, "a long, b long")


def _exact_links(grouped: DataFrame, least: float, tasks: int) -> DataFrame:
    """grouped (vec, label, embedding, same, node_group) -> (a, b, n): n vectors linked with a (b null), or an edge of the links' components.

    Pairs are compared block by block within a group; a group of several blocks is dealt out by pairs of blocks. A block
    is an eighth of its group, within bounds: a row is copied to eight tasks or, of larger groups, to one for each BLOCK of rows.
    """
    each = F.greatest(F.lit(BLOCK / BLOCKS), F.least(F.lit(float(BLOCK)), F.count("*") / BLOCKS))
    sizes = grouped.groupBy("node_group").agg(F.ceil(F.count("*") / each).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    # a group may be a third of all rows: the join deals it out by salt
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = grouped.withColumn("salt", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(SALTS)).cast("int")).join(sizes, ["node_group", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("vec", "label", "embedding", "same", "node_group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"))
    cells = cells.withColumn("task", F.pmod(F.xxhash64("node_group", "lo", "hi"), F.lit(tasks)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vec, label, same, group, lo, hi, second = (table.column(c).to_numpy().astype(np.int64) for c in ("vec", "label", "same", "node_group", "lo", "hi", "second"))
        vectors = table.column("embedding").chunk(0) if table.column("embedding").num_chunks else pa.array([], pa.list_(pa.float32()))
        length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((second, hi, lo, group, length, label))
        keys = np.stack([label, length, group, lo, hi])[:, order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])), len(order))
        a, b, n = [], [], []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[i:j]
            x = _unit(_matrix(vectors.take(pa.array(rows))))
            across = keys[3, i] != keys[4, i]
            mid = int(np.searchsorted(second[rows], 1)) if across else len(rows)
            near = x[:mid] @ (x[mid:] if across else x).T >= least
            if not across:
                np.fill_diagonal(near, False)
            left, right = rows[:mid], rows[mid:] if across else rows
            for side, links, partners in ((left, near, right), (right, near.T, left))[: 2 if across else 1]:
                got = links @ same[partners]
                a.append(vec[side][got > 0])
                b.append(np.full(int((got > 0).sum()), -1))
                n.append(got[got > 0])
            whole = np.zeros((len(rows), len(rows)), dtype=np.float32)
            whole[:mid, mid:] = near if across else 0
            whole = whole + whole.T if across else near.astype(np.float32)
            first = joined_by(whole > 0)
            moved = np.flatnonzero(first != np.arange(len(rows)))
            a.append(vec[rows[moved]])
            b.append(vec[rows[first[moved]]])
            n.append(np.zeros(len(moved), dtype=np.int64))
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
        n = cat(n)
        return pa.table([pa.array(cat(a)), pa.array(cat(b), mask=n > 0), pa.array(n)], ["a", "b", "n"])

    return cells.groupBy("task").applyInArrow(compare, "a long, b long, n long")


def joined_by(near: np.ndarray) -> np.ndarray:
    """For each row the first row of its component, by a table of links."""
    first = np.arange(len(near))
    open_ = np.flatnonzero(near.any(axis=1))
    while len(open_):
        seed, queue = open_[0], open_[:1]
        open_ = open_[1:]
        while len(queue) and len(open_):
            reached = near[np.ix_(queue, open_)].any(axis=0)
            queue, open_ = open_[reached], open_[~reached]
            first[queue] = seed
    return first


def near_vectors(vectors: DataFrame, least: float = 0.98, miss: float = 0.001, sigmas: float = 5.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each of vectors: id, n_links, component_id, kept (id = component_id).

    Vectors link when their labels and lengths are equal and their cosine, in double precision, is least or more. Vectors
    that are null, empty or zero, hold null or non-finite components, or have a null label or id link with nothing. n_links counts the other
    vectors linked directly; component_id is the smallest id reachable. No link under least is ever made; a pair at the
    very least is missed with probability miss at most, a closer one with less. Rows that repeat id, label and vector are one
    vector. Ids are meant to be unique: under one id, different vectors that stand for their copies share their links. Empty table: empty.

    1. Equal vectors of a label are one class, by a 128-bit fingerprint; the rest is done with one of each.
    2. Bands of the codes' bits deal the classes into buckets: their width follows the largest label, their number the
       width. In a bucket codes are compared by estimate and bound, which gives groups beyond which there is no link.
    3. Within a group cosines are computed from the vectors, block by block.
    Buckets and groups over a fixed size are dealt out by pairs of parts, so no task holds more than two parts.
    """
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))
    prints = [F.when(valid, F.xxhash64(F.lit(k), F.col(label_col), v)).alias(name) for k, name in ((1, "lo"), (2, "hi"))]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.xxhash64(label_col).alias("label"), v.alias("embedding"), *prints)
    keyed = rows.select("vec", "lo", "hi")
    classes = materialise(keyed.where("lo IS NOT NULL").groupBy("lo", "hi").agg(F.min("vec").alias("first"), F.count_distinct("vec").alias("same")), "vector-classes")
    facts = rows.where("lo IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    spark = vectors.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (facts[0] or 0) * 400 // (16 << 20))
    one = rows.where("lo IS NOT NULL").join(classes.select("lo", "hi", F.col("first").alias("vec")), ["lo", "hi", "vec"], "left_semi")
    one = materialise(one.dropDuplicates(["lo", "hi", "vec"]), "vectors")
    maybe = _maybe_links(one.select("vec", "label", "embedding"), least, miss, sigmas, facts[0] or 0, facts[1] or 0)
    groups = components(maybe, "vector-groups").toDF("vec", "node_group")
    grouped = one.join(groups, "vec").join(classes.select("lo", "hi", "same"), ["lo", "hi"]).drop("lo", "hi")
    links = materialise(_exact_links(grouped, least, tasks), "vector-links")
    counts = links.where("n > 0").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("links"))
    joined_ = components(links.where("b IS NOT NULL").select("a", "b"), "vector-components").toDF("first", "component")
    known = classes.join(counts, "first", "left").join(joined_, "first", "left")
    known = known.select("lo", "hi", F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("same") - 1).alias("links"))
    out = keyed.join(known, ["lo", "hi"], "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec") == component).alias("kept"))

"""Merkle manifest of a dataset: digests of rows are reduced to a digest of each group and one of the whole, with proofs.

Superblock reduction: the leaves of a group are numbered from 0, and fanout^levels consecutive ones are a bucket. A bucket is
one call of applyInPandas, which collapses that many levels of the tree at once; the buckets' roots are the next round's
leaves. On the way back down a bucket meets its root's proof, and a leaf's proof is its siblings within the bucket
followed by that. So no task ever holds more than one bucket, whatever a group's size, and a leaf is moved once for each way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.shared import discard, materialise

FANOUT = 16
#: Levels of a bucket: 256 leaves at the usual fanout.
LEVELS = 2
#: Rows of a range of the order that numbers leaves.
PER_RANGE = 1 << 20
_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """A value as its bytes' count, a colon and itself; null is a dash. So no two lists of values read alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256 of values one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)), 256))


def lowered(text: Column) -> Column:
    """text with its A-Z in lower case."""
    return F.translate(text, _AZ, _LOW)


def digest(parts: Sequence[bytes]) -> bytes:
    """SHA-256 over hexadecimal digests one after the other, as lower-case hexadecimal."""
    return sha256(b"".join(parts)).hexdigest().encode()


def depth(n: int, fanout: int) -> int:
    """Levels over n nodes until one remains."""
    k = 0
    while n > 1:
        n = -(-n // fanout)
        k += 1
    return k


def collapse(nodes: list[bytes], steps: int, fanout: int) -> list[list[bytes]]:
    """The nodes of each level, those given first; a run of one is hashed as any other."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest(below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[bytes]], fanout: int) -> Iterator[tuple[bytes, bytes]]:
    """For each node of the lowest level the others of its run, level by level, and a byte for how many are left of it and one for how many right."""
    above = [(b"", b"")] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        runs = [b"".join(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        mine = []
        for k in range(len(nodes)):
            run, at = runs[k // fanout], k % fanout
            up, shape = above[k // fanout]
            mine.append((run[: 64 * at] + run[64 * (at + 1) :] + up, bytes((at, len(run) // 64 - at - 1)) + shape))
        above = mine
    yield from above


def fold(start: bytes, proof: bytes, shape: bytes) -> bytes:
    """The root that a leaf's hexadecimal digest comes to by a proof."""
    at, node = 0, start
    for k in range(0, len(shape), 2):
        middle, end = at + 64 * shape[k], at + 64 * (shape[k] + shape[k + 1])
        node = digest([proof[at:middle], node, proof[middle:end]])
        at = end
    return node


def _numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with idx, the place within group from 0 by order, nulls first, and m, the group's rows.

    Ranges of the order over all groups are numbered on their own and start where those before them end. So a group may be as large
    as the table; rows equal in order are told apart by the number that tie has.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PER_RANGE))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = materialise(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), name)
    each = ranged.groupBy(group, "part").agg(F.count("*").alias("here"))
    all_ = Window.partitionBy(group)
    starts = each.select(group, "part", (F.sum("here").over(all_.orderBy("part")) - F.col("here")).alias("start"), F.sum("here").over(all_).alias("m"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    out = materialise(ranged.withColumn("_place", place).join(starts, [group, "part"]).withColumn("idx", F.col("start") + F.col("_place") - 1).drop("_place", "part", "start"), name)
    discard(ranged)
    return out


def _up(items: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of the buckets of items (g, idx, m, digest)."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        m = int(rows["m"].iloc[0])
        top = collapse([d.hex().encode() for d in rows["digest"]], min(levels, depth(m, fanout)), fanout)[-1]
        return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "m": [-(-m // fanout**levels)], "digest": [bytes.fromhex(top[0].decode())]})

    bucket = F.floor(F.col("idx") / F.lit(fanout**levels)).alias("bucket")
    many = items.where("m > 1").select("g", "idx", "m", "digest").groupBy("g", bucket).applyInPandas(reduce, "g string, idx long, m long, digest binary")
    return many.unionByName(items.where("m = 1").select("g", "idx", "m", "digest"))


def _stages(items: DataFrame, most: int, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """items and the buckets' roots of each round; the last has one row for each group."""
    out = [items]
    while most > 1:
        out.append(materialise(_up(out[-1], fanout, levels), name))
        most = -(-most // fanout**levels)
    return out


def _down(items: DataFrame, above: DataFrame, fanout: int, levels: int, keep: dict[str, str], leaves: bool) -> DataFrame:
    """Proofs of items from the proofs (g, bucket, up, up_shape, subroot, root) of their buckets.

    keep: columns of items that stay. leaves: the result has digests, the folded root and the proofs' own digest as well.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("idx")
        up, up_shape, subroot, root = right[["up", "up_shape", "subroot", "root"]].iloc[0]
        nodes = [d.hex().encode() for d in left["digest"]]
        proofs = [(a + up, b + up_shape) for a, b in siblings(collapse(nodes, min(levels, depth(int(left["m"].iloc[0]), fanout)), fanout), fanout)]
        out = left[["g", "idx", *keep]].assign(proof=[a for a, _ in proofs], shape=[b for _, b in proofs], subroot=subroot, root=root)
        if leaves:
            start = [n if c is None else c.hex().encode() for n, c in zip(nodes, left["changed"], strict=True)]
            out = out.assign(leaf=[n.decode() for n in nodes], proof_sha256=[sha256(a).hexdigest() for a, _ in proofs], folded_root=[fold(s, a, b).decode() for s, (a, b) in zip(start, proofs, strict=True)])
        return out

    extra = "".join(f", {c} {t}" for c, t in keep.items())
    schema = f"g string, idx long{extra}, proof binary, shape binary, subroot string, root string" + ", leaf string, proof_sha256 string, folded_root string" * leaves
    bucket = F.floor(F.col("idx") / F.lit(fanout**levels)).alias("bucket")
    names = ["g", "idx", "m", "digest", *keep, *["changed"] * leaves]
    return items.select(*names).groupBy("g", bucket).cogroup(above.groupBy("g", "bucket")).applyInPandas(meet, schema)


def _descend(stages: list[DataFrame], above: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Proofs (g, bucket, up, up_shape, subroot, root) of the buckets of the lowest stage from those of the groups' roots."""
    for items in stages[:0:-1]:
        below = _down(items, above, fanout, levels, {}, leaves=False)
        above = materialise(below.select("g", F.col("idx").alias("bucket"), F.col("proof").alias("up"), F.col("shape").alias("up_shape"), "subroot", "root"), name)
    return above


def merkle_manifest(
    docs: DataFrame, changed: Column | None = None, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source",
    changes: str = "text", fanout: int = FANOUT, levels: int = LEVELS, with_proofs: bool = False,
) -> DataFrame:
    """One row for each of docs: its id, leaf, subroot of its source, root, proof_sha256, folded_root and verified.

    leaf: SHA-256 of fields, each with its length; null is a dash. Per source leaves ascend by id (nulls first, then by digest), and while
    there are several, every fanout of them become their digest, a last run of one too; what remains is subroot. Subroots, in the
    order of source (null first, then by bytes), become root in the same way. proof_sha256: digest of the siblings
    left to right, level by level up to root. folded_root: the root that the leaf comes to by its proof, with the column changes replaced by
    the expression changed where that isn't null; verified says whether that is root.
    with_proofs: also proof (siblings' hexadecimal digests, one after the other) and shape (per level a byte for how many of
    them are left of the node and one for how many right), for fold().

    A source may be null or hold all rows; ids may be null or repeat; equal rows each have a leaf of their own.
    Empty table: empty. Other columns of docs aren't read. ValueError: fanout over 255 or under 2.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("fanout has to be from 2 to 255")
    spark = docs.sparkSession
    columns = {c: F.col(c) for c in fields}
    other = F.when(changed.isNotNull(), leaf(*(changed if c == changes else v for c, v in columns.items()))) if changed is not None else F.lit(None).cast("binary")
    known = {"id": dict(docs.dtypes)[id_col]}
    group = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("g")
    rows = materialise(docs.select(F.col(id_col).alias("id"), group, leaf(*columns.values()).alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    leaves = _numbered(rows, "g", ["id", "digest", "tie"], "merkle-numbered").drop("tie")
    most = leaves.agg(F.max("m")).first()[0]
    stages = _stages(leaves, most or 0, fanout, levels, "merkle-stage")
    roots = stages[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "digest") if most else leaves.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest")
    sources = _numbered(roots, "g", ["source"], "merkle-sources")
    upper = _stages(sources, sources.count(), fanout, levels, "merkle-upper")
    top = upper[-1].select("digest").first()
    root = "" if top is None else top[0].hex()
    empty = F.lit(b"")
    above = spark.range(int(top is not None)).select(F.lit("").alias("g"), F.lit(0).cast("long").alias("bucket"), empty.alias("up"), empty.alias("up_shape"), F.lit("").alias("subroot"), F.lit(root).alias("root"))
    above = _descend(upper, above, fanout, levels, "merkle-paths")
    paths = _down(sources.withColumn("own", F.col("digest")), above, fanout, levels, {"source": "string", "own": "binary"}, leaves=False)
    paths = materialise(paths.select(F.col("source").alias("g"), F.lit(0).cast("long").alias("bucket"), F.col("proof").alias("up"), F.col("shape").alias("up_shape"), F.lower(F.hex("own")).alias("subroot"), "root"), "merkle-paths")
    found = _down(leaves, _descend(stages, paths, fanout, levels, "merkle-paths"), fanout, levels, known, leaves=True)
    proofs = ["proof", "shape"] if with_proofs else []
    discard(rows)
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *proofs)

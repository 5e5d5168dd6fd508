import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from engram.llm.merkle import fold, lowered, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hexed(text):
    return sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hexed("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, at, fanout):
    """The others of each run on the way to the root, left and right."""
    out = []
    for nodes in levels[:-1]:
        start = at // fanout * fanout
        run = nodes[start : start + fanout]
        out.append((run[: at - start], run[at - start + 1 :]))
        at //= fanout
    return out


def brute(rows, fanout=16):
    leaf = lambda r, text: hexed("".join(value(v) for v in (r[0], r[3], r[2], r[4], text)))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by_source, key=lambda s: b"" if s is None else b"0" + s.encode())
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by_source[s]], fanout)
    top = tree([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for at, (_, _, digest, r) in enumerate(by_source[s]):
            path = way(trees[s], at, fanout) + way(top, k, fanout)
            node = digest
            if r[0] is not None and r[1] is not None and crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                node = hexed("".join([*left, node, *right]))
            proof = hexed("".join("".join(a + b) for a, b in path))
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, **more):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered(F.col("text")))
    return merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), changed, **more)


def documents(sizes, seed=1):
    r = random.Random(seed)
    ids = r.sample(range(10**9), sum(sizes.values()))
    texts = ["", "Plain words", "über ÄÖÜ", "ABC\nd", "lower only", None, "x" * 5000]
    return [(ids.pop(), r.choice(texts), r.choice(["en", None]), s, r.choice([None, 3, 77])) for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, None: 1}, {"b": 257, None: 40, "é": 15, "": 2, "Z": 1}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_against_brute_force(spark, sizes):
    rows = documents(sizes)
    assert sorted(map(tuple, found(spark, rows).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (4, 1)])
def test_other_fanouts_and_several_rounds(spark, fanout, levels):
    rows = documents({"a": 70, "b": 1, "c": 9, None: 3}, 2)
    assert sorted(map(tuple, found(spark, rows, fanout=fanout, levels=levels).collect()), key=str) == brute(rows, fanout)


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(None, None, None, None, None)] * 20 + [(7, "A", "en", "s", 1)] * 18 + [(7, "B", "en", "s", 1), (0, "", None, "s", None)]
    got = found(spark, rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("g", "idx", "m", "digest", "tie", "part", "id", "changed", "leaf", "root"):
        df = df.withColumn(c, F.lit(c))
    assert sorted(r.leaf for r in merkle_manifest(df).collect()) == sorted(r[1] for r in brute(rows))
    assert all(r.verified for r in merkle_manifest(df).collect())
    assert found(spark, []).count() == 0


def test_proofs_fold_to_the_root(spark):
    rows = documents({"a": 300, "b": 5}, 3)
    for r in found(spark, rows, with_proofs=True).collect():
        assert sha256(r.proof).hexdigest() == r.proof_sha256
        assert fold(r.leaf.encode(), bytes(r.proof), bytes(r["shape"])).decode() == r.root
        assert fold(r.leaf[::-1].encode(), bytes(r.proof), bytes(r["shape"])).decode() != r.root
    with pytest.raises(ValueError, match="fanout"):
        found(spark, rows, fanout=256)

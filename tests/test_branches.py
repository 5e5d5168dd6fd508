import random

import pytest
from pyspark.sql import functions as F

from engram.operators.graph import largest_paths, subtree_sizes
from engram.sources.importers import canonical_branch


def tree(shape, n, r):
    """Parents by node, 0 the root."""
    if shape == "comb":
        return {k: None if k == 0 else k - 2 + k % 2 if k > 1 else 0 for k in range(n)}
    if shape == "star":
        return {k: 0 if k else None for k in range(n)}
    if shape == "chain":
        return {k: k - 1 if k else None for k in range(n)}
    return {k: r.randrange(max(0, k - 6), k) if k else None for k in range(n)}


def sizes(parents):
    out = dict.fromkeys(parents, 1)
    for k in sorted(parents, reverse=True):
        if parents[k] is not None:
            out[parents[k]] += out[k]
    return out


def walk(parents):
    size, at, out = sizes(parents), 0, []
    while at is not None:
        out.append(at)
        children = sorted(k for k, p in parents.items() if p == at)
        at = max(children, key=lambda k: size[k]) if children else None
    return out


@pytest.fixture(scope="module")
def forest():
    r = random.Random(1)
    return {f"{s}{n}": tree(s, n, r) for s, n in (("comb", 5000), ("chain", 5000), ("star", 5000), ("any", 3000), ("any", 1), ("chain", 2), *(("any", k) for k in range(3, 40)))}


def test_sizes_and_paths_of_deep_and_wide_trees(spark, forest):
    rows = [(c, k, p) for c, parents in forest.items() for k, p in parents.items()]
    links = spark.createDataFrame(rows, "conv string, node long, parent long").repartition(4)
    got = {(r.conv, r.node): r["size"] for r in subtree_sizes(links, ["conv"]).collect()}
    assert got == {(c, k): n for c, parents in forest.items() for k, n in sizes(parents).items()}
    found = {}
    for r in sorted(largest_paths(links, ["conv"], [F.col("node")]).collect(), key=lambda r: r.place):
        found.setdefault(r.conv, []).append(r.node)
    assert found == {c: walk(parents) for c, parents in forest.items()}


NODE = "conv string, current string, node string, parent string, at double, pos int, children array<string>"


def branch(spark, rows):
    out = {}
    for r in sorted(canonical_branch(spark.createDataFrame(rows, NODE)).collect(), key=lambda r: r.place):
        assert r.place == len(out.setdefault(r.conv, []))
        out[r.conv].append(r.node)
    return out


def test_branches_with_and_without_current_nodes(spark):
    rows = [
        # a has the larger subtree, z is the newest
        ("big", None, "root", None, 1.0, 0, ["z", "a"]), ("big", None, "a", "root", 2.0, 1, ["b"]), ("big", None, "b", "a", 3.0, 2, ["c"]), ("big", None, "c", "b", 4.0, 3, []), ("big", None, "z", "root", 9.0, 4, []),
        # of equal subtrees the one that the list has first; one that it hasn't comes last
        ("tie", "gone", "r", None, 1.0, 0, ["y", "x"]), ("tie", "gone", "w", "r", 1.0, 1, []), ("tie", "gone", "x", "r", 2.0, 2, None), ("tie", "gone", "y", "r", 3.0, 3, []),
        # the parent isn't there; of two roots the first in the file
        ("root", None, "k", "lost", 5.0, 1, ["l"]), ("root", None, "l", "k", 6.0, 2, []), ("root", None, "j", None, 0.0, 3, []),
        ("here", "m", "m", "n", 5.0, 1, []), ("here", "m", "n", None, 6.0, 2, ["m", "o"]), ("here", "m", "o", "n", 6.0, 3, ["p"]), ("here", "m", "p", "o", 6.0, 3, []),
        ("loop", None, "p", "q", 1.0, 0, ["q"]), ("loop", None, "q", "p", 1.0, 1, ["p"]),
        ("both", None, "s", None, 1.0, 0, []), ("both", None, "t", "u", 1.0, 1, ["u"]), ("both", None, "u", "t", 1.0, 2, ["t"]),
    ]
    assert branch(spark, rows) == {"big": ["root", "a", "b", "c"], "tie": ["r", "y"], "root": ["k", "l"], "here": ["n", "m"], "both": ["s"]}
    assert branch(spark, []) == {}

import random
import time

from pyspark.sql import functions as F

from engram.operators import graph as G

EDGES = "source long, target long, relation string"


def all_ways(edges, start, depth):
    """(depth, path, via) of all paths without repeated nodes, in order."""
    out, front = [(0, [start], "")], [(0, [start], "")]
    for d in range(1, depth + 1):
        front = [(d, [*p, b], r) for _, p, _ in front for a, b, r in edges if a == p[-1] and b not in p]
        out += front
    return sorted(out)


def test_capped_paths_are_the_first_of_all(spark):
    r = random.Random(5)
    edges = [(r.randrange(9), r.randrange(9), r.choice("xy")) for _ in range(25)]
    g = spark.createDataFrame(edges, EDGES)
    expected = all_ways(edges, 0, 4)
    plain = lambda df: sorted((x.depth, x.path, x.via or "") for x in df.collect())
    assert plain(G.traverse(g, 0, 4)) == expected
    for cap in (0, 1, 2, 7, 30, len(expected), len(expected) + 5):
        assert plain(G.traverse(g, 0, 4, cap=cap)) == expected[:cap]
    assert plain(G.traverse(g, 0, 3, "x")) == all_ways([e for e in edges if e[2] == "x"], 0, 3)


def test_capped_ancestors_are_the_first_of_all(spark):
    """Thoughts derive from several, some twice over, some from none that is stored, and two from each other."""
    r = random.Random(6)
    parents = {k: [r.randrange(-2, k) for _ in range(r.randrange(4))] for k in range(1, 30)} | {0: [3], 3: [0, 0]}
    rows = spark.createDataFrame([(k, p, "restricted" if k % 4 == 0 else None) for k, p in parents.items()], "id long, derived_from array<long>, sensitivity_tier string")
    out, front = [(0, 29, -1, False)], [(29, [29], False)]
    for d in range(1, 11):
        front = [(s, [*path, s], s in path, at) for at, path, cycle, *_ in front if not cycle for s in parents[at] if s in parents]
        out += [(d, s, at, cycle) for s, _, cycle, at in front]
    out.sort()
    for cap in (1, 5, 40, 2000):
        got = [(x.depth, x.id, -1 if x.parent is None else x.parent, x.cycle, x.restricted) for x in G.trace_provenance(rows, 29, cap=cap).collect()]
        assert [x[:3] for x in got] == [x[:3] for x in out[:cap]] and all(x[4] == (x[1] % 4 == 0) for x in got)
        assert sorted(x[:4] for x in got) == out[:cap] or cap < len(out)
    assert G.trace_provenance(rows, 99).count() == 0


def test_dense_graphs_stop_at_the_cap(spark):
    """300 nodes, each with an edge to each other: more than a billion ways of four steps."""
    a, b = spark.range(300).toDF("source"), spark.range(300).toDF("target")
    g = a.join(b, F.col("source") != F.col("target")).withColumn("relation", F.lit("x"))
    began = time.time()
    got = G.traverse(g, 0, 4, cap=2000).collect()
    assert len(got) == 2000 and max(x.depth for x in got) == 2 and time.time() - began < 60
    second = sorted((x.path for x in got if x.depth == 2))
    assert second == [[0, i, j] for i in range(1, 300) for j in range(1, 300) if i != j][: 2000 - 300]
    thoughts = g.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list("target")).alias("derived_from")).withColumns({"sensitivity_tier": F.lit("standard"), "content": F.lit("x")})
    assert G.trace_provenance(thoughts, 0, cap=500).count() == 500
    tree = G.provenance_tree(thoughts, 0, cap=250).collect()
    assert len(tree) == 250 and all(x.truncated for x in tree)


def test_shortest_paths_take_the_smallest_parent(spark):
    """Of two ways of one length that over the smaller last node before the goal counts, and of its edges the smaller relation."""
    g = spark.createDataFrame([(1, 5, "b"), (5, 9, "z"), (1, 4, "b"), (9, 4, "y"), (4, 9, "a"), (9, 12, "q"), (12, 12, "self"), (None, 1, "n"), (1, None, "n")], EDGES)
    assert [(x.step, x.node, x.relation) for x in sorted(G.shortest_path(g, 1, 12).collect())] == [(0, 1, None), (1, 4, "b"), (2, 9, "a"), (3, 12, "q")]
    assert G.shortest_path(g, 1, 12, max_depth=2).count() == 0 and G.shortest_path(g, 12, 12).count() == 1 and G.shortest_path(g.limit(0), 1, 1).count() == 0

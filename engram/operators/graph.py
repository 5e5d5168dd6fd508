"""Traversal of a graph of edges (source, target, relation) and of provenance, by joins of a frontier, depth after depth."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators.cut import cut

#: So many rows of paths may go to all tasks.
BROADCAST_ROWS = 10_000


def ways(first: DataFrame, step: Callable[[DataFrame], DataFrame], max_depth: int, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """Rows of first (with depth 0) and of what step makes of each depth's rows, depth after depth, so many at most, the first by depth and order.

    The next depth only needs the kept rows of the one before, because a way that is beyond the cap at its depth leaves no room for those
    that go on from it. So a graph with any number of ways costs cap rows a depth, and without a cap all its ways. Each depth is written.
    """
    levels = [cut(first if cap is None else first.orderBy(*order).limit(cap))]
    total = n = levels[0].count()
    for _ in range(max_depth):
        if not n or (cap is not None and total >= cap):
            break
        # with a cap the rows of a depth are few enough to meet the edges where these are
        at = levels[-1] if cap is None or cap > BROADCAST_ROWS else F.broadcast(levels[-1])
        rows = step(at)
        levels.append(cut(rows if cap is None else rows.orderBy(*order).limit(cap - total)))
        n = levels[-1].count()
        total += n
    return reduce(DataFrame.unionByName, levels)


def traverse(edges: DataFrame, start: int, max_depth: int = 3, relation: str | None = None, cap: int | None = None) -> DataFrame:
    """All directed paths without repeated nodes: (node, depth, via, path), the start with depth 0. One row for each path, not for each node.

    With a cap the first so many by depth, path and relation.
    """
    rows = edges if relation is None else edges.where(F.col("relation") == relation)
    ends = rows.select(F.col("source").cast("long").alias("_from"), F.col("target").cast("long").alias("_to"), F.col("relation").alias("_by"))
    first = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("via"), F.array(F.lit(start).cast("long")).alias("path"))

    def step(at: DataFrame) -> DataFrame:
        on = at.join(ends, F.col("_from") == F.col("node")).where(~F.array_contains("path", F.col("_to")))
        return on.select(F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("_by").alias("via"), F.array_append("path", F.col("_to")).alias("path"))

    return ways(first, step, max_depth, ["path", "via"], cap)


def shortest_path(edges: DataFrame, start: int, goal: int, max_depth: int = 6) -> DataFrame:
    """Steps (step, node, relation) of a shortest path over edges in either direction; nothing if there is none.

    A breadth-first frontier. The neighbours of nodes at one distance are at most one nearer or farther, so a round only leaves out the
    nodes of the last two rounds. Of several ways to a node the smallest (parent, relation) counts. start = goal is one step. Nodes without edges are unknown.
    """
    end = lambda a, b: F.struct(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("neighbour"), "relation")
    both = edges.select(F.inline(F.array(end("source", "target"), end("target", "source")))).where("neighbour IS NOT NULL")
    # what a node was reached from, by distance
    level = both.where(F.col("node") == start).limit(1).select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("relation"))
    levels = [cut(level)]
    found = lambda rows: rows.agg(F.count("*").alias("n"), F.count_if(F.col("node") == goal).alias("goal")).first()
    seen = found(levels[0])
    while seen.n and not seen.goal and len(levels) <= max_depth:
        step = both.join(levels[-1].select("node"), "node").groupBy(F.col("neighbour").alias("node")).agg(F.min(F.struct(F.col("node").alias("parent"), "relation")).alias("by"))
        past = reduce(DataFrame.unionByName, levels[-2:]).select("node")
        levels.append(cut(step.join(past, "node", "left_anti").select("node", "by.*")))
        seen = found(levels[-1])
    last = len(levels) - 1
    at = levels[-1].where(F.col("node") == goal)
    steps = [at.select(F.lit(last).cast("long").alias("step"), "node", "relation")]
    for k in range(last - 1, -1, -1):
        at = levels[k].join(F.broadcast(at.select(F.col("parent").alias("node"))), "node")
        steps.append(at.select(F.lit(k).cast("long").alias("step"), "node", "relation"))
    return reduce(DataFrame.unionByName, reversed(steps))


def doubled(links: DataFrame, keys: list[str]) -> DataFrame:
    """links (keys, node, parent), a node's parent or null -> (keys, node, top, depth): the topmost node above each and the way to it.

    Pointers double, so a chain of n nodes takes log2 n rounds of joins, and nodes of all chains move at once. A parent that is
    no node is the top itself. Nodes on a cycle, or below one, are left out.
    """
    known = links.select(*keys, F.col("node").alias("parent"), F.lit(True).alias("_known"))
    rows = links.join(known.distinct(), [*keys, "parent"], "left").select(*keys, "node", "parent", F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), (F.col("parent").isNotNull() & F.col("_known").isNotNull()).alias("open"))
    rows, left = cut(rows.withColumn("parent", F.coalesce("parent", "node")).dropDuplicates([*keys, "node"])), None
    while (n := rows.where("open").count()) and n != left:
        above = rows.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("depth").alias("_way"), F.col("open").alias("_open"))
        moved = rows.where("open").join(above, [*keys, "parent"]).select(*keys, "node", F.col("_up").alias("parent"), (F.col("depth") + F.col("_way")).alias("depth"), F.col("_open").alias("open"))
        rows, left = cut(rows.where("NOT open").unionByName(moved)), n
    return rows.where("NOT open").select(*keys, "node", F.col("parent").alias("top"), "depth")


def above(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, place): the nodes from the top down to a start, place 0 the topmost, for each (keys, node) of starts. Without cycles.

    The nodes above are marked by doubling too: of a marked node the one 2^k above, for falling k. Chains of any length.
    """
    placed = doubled(links, keys)
    jumps = [links.where("parent IS NOT NULL").select(*keys, "node", F.col("parent").alias("up"))]
    longest = placed.join(starts, [*keys, "node"], "left_semi").agg(F.max("depth")).first()[0] or 0
    while 2 ** len(jumps) <= longest:
        last = jumps[-1]
        jumps.append(cut(last.join(last.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next")), [*keys, "up"]).select(*keys, "node", F.col("_next").alias("up"))))
    marked = starts.select(*keys, "node").distinct()
    for jump in reversed(jumps):
        marked = cut(marked.unionByName(marked.join(jump, [*keys, "node"]).select(*keys, F.col("up").alias("node"))).distinct())
    ends = placed.where("depth > 0").select(*keys, F.col("top").alias("node"), "top", F.lit(0).cast("long").alias("depth")).distinct()
    every = placed.unionByName(ends.join(placed.select(*keys, "node"), [*keys, "node"], "left_anti"))
    return marked.join(every, [*keys, "node"]).select(*keys, "node", F.col("depth").alias("place"))


def subtree_sizes(links: DataFrame, keys: list[str]) -> DataFrame:
    """links (keys, node, parent), one row for each node, parent a node or null -> (keys, node, size): the nodes at and below each.

    After k rounds a node knows how many nodes are less than 2^k below it and which one is 2^k above; a round adds to
    it what the nodes 2^k below know. So a tree of n nodes of any shape takes n rows a round and as many rounds as the logarithm of its depth.
    Nodes on a cycle, or above none but such, get no size of meaning, and what is below a root is not among them.
    """
    rows = cut(links.select(*keys, "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else rows.count()
    for _ in range((most or 1).bit_length()):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        gain = rows.where("up IS NOT NULL").groupBy(*keys, F.col("up").alias("node")).agg(F.sum("size").alias("_gain"))
        jump = rows.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"))
        rows = cut(rows.join(gain, [*keys, "node"], "left").join(jump, [*keys, "up"], "left").select(*keys, "node", F.col("_next").alias("up"), (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size")))
    return rows.select(*keys, "node", "size")


def largest_paths(links: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(keys, node, place): for each keys the way from the first root down, at each node to the child with the largest subtree, place 0 at the root.

    links (keys, node, parent, and what order needs), one row for each node; a parent that is null or no node makes a root. Of
    roots, and of children with subtrees of one size, the first by order. Nothing where there is no root, as where all nodes are on cycles.
    """
    known = links.select(*keys, F.col("node").alias("parent"), F.lit(True).alias("_known"))
    rows = cut(links.join(known, [*keys, "parent"], "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known"))
    roots = rows.where("parent IS NULL").groupBy(*keys).agg(F.min_by("node", F.struct(*order, "node")).alias("top"))
    sized = rows.join(subtree_sizes(rows, keys), [*keys, "node"])
    best = sized.where("parent IS NOT NULL").groupBy(*keys, "parent").agg(F.min_by("node", F.struct(-F.col("size"), *order, "node")).alias("node"), F.lit(True).alias("_best"))
    heavy = rows.join(best, [*keys, "parent", "node"], "left").select(*keys, "node", F.when(F.col("_best"), F.col("parent")).alias("parent"))
    return doubled(heavy, keys).join(roots, [*keys, "top"]).select(*keys, "node", F.col("depth").alias("place"))


def parent_chain(parents: DataFrame, start: int) -> DataFrame:
    """(node, place): the chain of parents (node, parent) above a node, place 0 the topmost. A chain of any length; nothing if it runs into a cycle."""
    begin = parents.sparkSession.createDataFrame([(start,)], "node bigint")
    links = parents.select(F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))
    alone = begin.join(links, "node", "left_anti").join(links.select(F.col("parent").alias("node")), "node", "left_anti").withColumn("place", F.lit(0).cast("long"))
    return above(links, begin, []).unionByName(alone)


def trace_provenance(thoughts: DataFrame, start: int, max_depth: int = 10, cap: int = 2000) -> DataFrame:
    """Ancestors by derived_from: (id, depth, parent, cycle, restricted), in order of depth and id, so many at most.

    One row for each way to an ancestor. An ancestor that is on its own way is given once with cycle and not followed.
    """
    known = thoughts.select(F.col("id").alias("_id"), F.col("derived_from").alias("_sources"), (F.coalesce("sensitivity_tier", F.lit("")) == "restricted").alias("_restricted"))
    first = known.where(F.col("_id") == start).select(F.col("_id").alias("id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(False).alias("cycle"), F.col("_restricted").alias("restricted"), F.array("_id").alias("path"), F.col("_sources").alias("sources"))

    def step(at: DataFrame) -> DataFrame:
        up = at.where("NOT cycle").select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"), "path", F.explode("sources").alias("id"))
        up = up.select("*", F.array_contains("path", F.col("id")).alias("cycle"))
        return up.join(known, F.col("_id") == F.col("id")).select("id", "depth", "parent", "cycle", F.col("_restricted").alias("restricted"), F.array_append("path", F.col("id")).alias("path"), F.col("_sources").alias("sources"))

    cap = min(cap, 2000)
    return ways(first, step, min(max_depth, 10), ["id", "parent", "path"], cap).select("id", "depth", "parent", "cycle", "restricted").orderBy("depth", "id", F.asc_nulls_first("parent"))


def derivatives(thoughts: DataFrame, of: int, limit: int = 500) -> DataFrame:
    """Thoughts derived from one; restricted ones, and ones without a tier, are hidden."""
    return thoughts.where(F.array_contains("derived_from", F.lit(of).cast("bigint")) & (F.col("sensitivity_tier") != "restricted")).orderBy(F.desc("created_at"), F.desc("id")).limit(min(limit, 500))


def provenance_tree(thoughts: DataFrame, start: int, max_depth: int = 5, cap: int = 250) -> DataFrame:
    """The ancestors of a thought as nodes of a tree: (path, id, depth, under, cycle, restricted, preview, parents, nodes, truncated).

    A node stands for one way from the start and under is the path of the node that it hangs under, so a thought that is reached twice is
    there twice; parents counts the nodes under a node. An ancestor that is on its own way has cycle and nothing else to it. The first cap
    nodes by depth and path are kept, and truncated says whether there were more. Restricted texts have no preview.
    """
    known = thoughts.select(F.col("id").alias("_id"), F.array_distinct("derived_from").alias("_sources"), (F.coalesce("sensitivity_tier", F.lit("")) == "restricted").alias("_restricted"), X.preview(F.col("content")).alias("_preview"))
    kept = [F.col("_restricted").alias("restricted"), F.col("_preview").alias("preview"), F.col("_sources").alias("sources")]
    first = known.where(F.col("_id") == start).select(F.col("_id").alias("id"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cycle"), F.array("_id").alias("path"), *kept)

    def step(at: DataFrame) -> DataFrame:
        up = at.where("NOT cycle").select((F.col("depth") + 1).alias("depth"), "path", F.explode("sources").alias("id")).select("*", F.array_contains("path", F.col("id")).alias("cycle"))
        return up.join(known, F.col("_id") == F.col("id")).select("id", "depth", "cycle", F.array_append("path", F.col("id")).alias("path"), *kept)

    # one row more than are kept shows whether there are more
    rows = ways(first, step, min(max_depth, 10), ["path"], cap + 1)
    n = rows.count()
    joined = lambda c: F.array_join(c.cast("array<string>"), "/")
    nodes = rows.orderBy("depth", "path").limit(cap).select(joined(F.col("path")).alias("path"), "id", "depth", F.when(F.col("depth") > 0, joined(F.slice("path", F.lit(1), F.size("path") - 1))).alias("under"), "cycle", "restricted", F.when(~F.col("restricted") & ~F.col("cycle"), F.col("preview")).alias("preview"))
    under = nodes.where("under IS NOT NULL").groupBy(F.col("under").alias("path")).agg(F.count("*").alias("parents"))
    return nodes.join(under, "path", "left").withColumn("parents", F.coalesce("parents", F.lit(0)).cast("long")).withColumns({"nodes": F.lit(min(n, cap)).cast("long"), "truncated": F.lit(n > cap)})

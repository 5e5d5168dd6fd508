"""Joins of a memory store that need more than one line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.cut import cut


def with_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    names = entities.select("entity_id", "canonical_name")
    return edges.join(names.toDF("from_id", "from_name"), "from_id").join(names.toDF("to_id", "to_name"), "to_id")


def neighbours(edges: DataFrame, source: str, target: str, relation: str = "relation") -> DataFrame:
    """Both directions of directed edges as rows (node, neighbour, relation, direction)."""
    row = lambda a, b, d: edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), relation, F.lit(d).alias("direction"))
    return row(source, target, "outgoing").unionByName(row(target, source, "incoming"))


def shared_pairs(links: DataFrame, least: int, item: str, group: str, direct: float = 100.0, block: int = 10_000, per_task: int = 2_000_000) -> DataFrame:
    """Pairs (a, b, shared) of items that share so many groups or more. Repeated links count once, nulls not at all.

    While the groups hold at most `direct` pairs for each link, pairs are counted group by group. Beyond that, two items of n groups that share
    k are found by the n - k + 1 rarest groups of each, since k - 1 others can't hold all that they share; so a group that most
    items have is looked at only where items have little else. What is found is then counted by joins. Groups of over `block` items are met
    in blocks. Pairs are dealt out before they are counted, some `per_task` of the groups' pairs to a task, so a task's table of counts doesn't grow with the input.
    """
    rows = links.select(F.col(item).alias("i"), F.col(group).alias("g")).where("i IS NOT NULL AND g IS NOT NULL").distinct()
    sizes = rows.groupBy("g").agg(F.count("*").alias("df"))
    cost = sizes.agg(F.sum(F.col("df") * (F.col("df") - 1.0) / 2).alias("pairs"), F.sum("df").alias("links")).first()
    if least < 2 or (cost.pairs or 0) <= direct * (cost.links or 0):
        x, y = rows.select(F.col("i").alias("a"), "g"), rows.select(F.col("i").alias("b"), "g")
        met = x.join(y, "g").where("a < b").select("a", "b")
        if (cost.pairs or 0) > per_task:
            met = met.repartition(math.ceil(cost.pairs / per_task), "a", "b")
        return met.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    rows = cut(rows)
    counts = rows.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rare = F.row_number().over(Window.partitionBy("i").orderBy("df", "g"))
    heads = cut(rows.join(counts, "i").join(sizes, "g").withColumn("nth", rare).where(F.col("nth") <= F.col("n") - least + 1).select("i", "g"))
    blocks = heads.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    cells = heads.join(blocks, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = cells.select("g", F.col("i").alias("a"), F.pmod(F.xxhash64("i"), F.col("blocks")).alias("cell"))
    all_ = cells.select("g", F.col("i").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("cell"))
    found = one.join(all_, ["g", "cell"]).where("a < b").select("a", "b").distinct()
    both = found.join(rows.withColumnRenamed("i", "a"), "a").join(rows.withColumnRenamed("i", "b"), ["b", "g"])
    return both.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def connections(thoughts: DataFrame, anchor: int) -> DataFrame:
    """Thoughts that share topics or people with one of them: shared lists and their sizes' sum. Restricted ones and those without a tier go."""
    one = thoughts.where(F.col("id") == anchor).select(F.col("topics").alias("_topics"), F.col("people").alias("_people"))
    rows = thoughts.where((F.col("id") != anchor) & (F.col("sensitivity_tier") != "restricted")).crossJoin(F.broadcast(one.limit(1)))
    rows = rows.withColumn("shared_topics", F.filter("topics", lambda x: F.array_contains(F.col("_topics"), x))).withColumn("shared_people", F.filter("people", lambda x: F.array_contains(F.col("_people"), x)))
    return rows.withColumn("overlap", (F.size("shared_topics") + F.size("shared_people")).cast("bigint")).where("overlap > 0").drop("_topics", "_people")


def fuzzy_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Matches (name, entity_id, how) of names with entities (entity_id, canonical_name): equal, first_word or contained, the best of each name.

    Equal names and first words of three letters or more meet by hash; containment by the words that both have. Of entities with one name only the first
    can be the best, so a name is joined once and not for each of its entities.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    n = names.select("name", norm("name").alias("k")).distinct()
    e = entities.groupBy(norm("canonical_name").alias("ek")).agg(F.min(F.struct("entity_id")).alias("m")).select("m.entity_id", "ek")
    first = lambda c: F.when(F.length(F.element_at(F.split(c, " "), 1)) >= 3, F.element_at(F.split(c, " "), 1))
    equal = n.join(e, F.col("k") == F.col("ek")).select("name", "entity_id", F.lit(1).alias("rank"))
    word = n.withColumn("w", first(F.col("k"))).join(e.withColumn("w", first(F.col("ek"))), "w").select("name", "entity_id", F.lit(2).alias("rank"))
    inside = n.withColumn("w", F.explode(F.array_distinct(F.split("k", " ")))).join(e.withColumn("w", F.explode(F.array_distinct(F.split("ek", " ")))), "w")
    inside = inside.where(F.contains("k", "ek") | F.contains("ek", "k")).select("name", "entity_id", F.lit(3).alias("rank"))
    best = equal.unionByName(word).unionByName(inside).groupBy("name").agg(F.min(F.struct("rank", "entity_id")).alias("m"))
    how = F.element_at(F.array(F.lit("equal"), F.lit("first_word"), F.lit("contained")), F.col("m.rank"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.col("m.entity_id").alias("entity_id"), F.when(F.col("m").isNull(), "new").otherwise(how).alias("how"))


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

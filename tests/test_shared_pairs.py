import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from engram.operators.joins import shared_pairs


def plain(df):
    return sorted(map(tuple, df.select("a", "b", "shared").collect()))


@pytest.mark.parametrize("direct", [1e9, 0.0])
def test_pairs_against_all_pairs(spark, direct):
    """Both ways, groups in blocks of three, repeated links and nulls."""
    r = random.Random(8)
    items = {k: {min(int(r.expovariate(0.12)), 30) for _ in range(r.randrange(7))} for k in range(60)}
    links = [(k, g) for k, gs in items.items() for g in gs] * 2 + [(None, 1), (1, None)]
    df = spark.createDataFrame(links, "item long, grp long")
    for least in (1, 2, 3, 5):
        expected = [(a, b, n) for a, b in combinations(sorted(items), 2) if (n := len(items[a] & items[b])) >= least]
        assert plain(shared_pairs(df, least, "item", "grp", direct, block=3)) == expected
    assert plain(shared_pairs(df.limit(0), 2, "item", "grp", direct)) == []


def test_a_group_of_most_items_is_no_square(spark):
    """100,000 items have group 0 and each two share one of their own: five billion pairs meet in group 0 and 50,000 are asked for."""
    items = spark.range(100_000).withColumnRenamed("id", "item")
    links = items.select("item", F.lit(0).cast("long").alias("grp")).unionByName(items.select("item", (F.floor(F.col("item") / 2) + 1).alias("grp")))
    got = shared_pairs(links, 2, "item", "grp")
    assert got.agg(F.count("*"), F.min("shared"), F.max("shared"), F.max(F.col("b") - F.col("a"))).first()[:] == (50_000, 2, 2, 1)


def test_all_pairs_are_classified(spark):
    """Every pair of a text, by brute force, is asked about: none is left out because others share more."""
    from engram.plans import all_queries

    sf = "/root/testdata/sf0.001"
    of = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect():
        of.setdefault(r.l_partkey, []).append(r.l_orderkey)
    shared = Counter(pair for orders in of.values() for pair in combinations(sorted(orders), 2))
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    got = [(r.a, r.b) for r in all_queries()[0]["f03_pair_relations"](spark, sf).collect()]
    assert sorted(got) == sorted((a, b) for (a, b), n in shared.items() if n >= 2 and a in docs) and len(got) > 200

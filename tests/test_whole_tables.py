"""Queries over whole tables, against brute force."""

from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq

from engram.plans import all_queries

QUERIES = all_queries()[0]
SF = "/root/testdata/sf0.01"


def rows(name, *columns, sf=SF):
    return list(zip(*[pq.read_table(f"{sf}/{name}.parquet").column(c).to_pylist() for c in columns], strict=True))


def test_entities_of_all_parts(spark):
    got = QUERIES["g12_wiki_payload"](spark, SF).collect()
    links = Counter(part for _, part in set(rows("lineitem", "l_orderkey", "l_partkey")))
    assert {r.entity_id: r.thoughts for r in got} == {k: links[k] for (k,) in rows("part", "p_partkey")} and len(got) > 200


def test_names_of_all_parts(spark):
    got = QUERIES["f02_entities"](spark, SF).groupBy("entity_id").count().collect()
    parts = {k for k, name in rows("part", "p_partkey", "p_name") if name in ("small ring", "red widget")}
    assert parts <= {r.entity_id for r in got} and max(parts) >= 200


def test_pairs_of_all_lines(spark):
    sf = "/root/testdata/sf0.001"
    of = {}
    for order, part in set(rows("lineitem", "l_orderkey", "l_partkey", sf=sf)):
        of.setdefault(part, []).append(order)
    shared = Counter(pair for orders in of.values() for pair in combinations(sorted(orders), 2))
    docs = {d for (d,) in rows("documents", "doc_id", sf=sf)}
    best = sorted((-n, a, b) for (a, b), n in shared.items() if n >= 2 and a in docs)[:200]
    got = QUERIES["f03_pair_relations"](spark, sf).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for _, a, b in best}

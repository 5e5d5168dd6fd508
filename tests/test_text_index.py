import random
import re

import pytest
from pyspark.sql import functions as F

from engram.operators.cut import folder
from engram.operators.search import matches, web_query
from engram.operators.text_index import TextIndex, cover_rank

QUERIES = ["a", "a b", '"a b"', "a or b", '"a b" c or d -e', "a -b", "-a", "a a", '"a a" b', "zz", "", 'c or -a b', '"b c a" or "c a"']
KIND = "id long, content string"


def brute(query, text):
    """Sum over all stretches that satisfy the query and have no other such stretch within."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    groups = [[ws for negative, ws in g if not negative] for g in web_query(query)]
    asked = {w for g in groups for ws in g for w in ws}
    has = lambda a, b, ws: any(words[i : i + len(ws)] == ws for i in range(a, b - len(ws) + 2))
    good = {(a, b) for a in range(len(words)) for b in range(a, len(words)) if any(g and all(has(a, b, ws) for ws in g) for g in groups)}
    least = [(a, b) for a, b in good if (a + 1, b) not in good and (a, b - 1) not in good]
    return sum(0.1 / (1 + sum(w not in asked for w in words[a : b + 1])) for a, b in least)


def texts(seed, n, start=0):
    r = random.Random(seed)
    return [(start + k, " ".join(r.choice("aabbcdeé-f") for _ in range(r.randint(0, 25)))) for k in range(n)] + [(start + n, None), (start + n + 1, "A, B! c")]


@pytest.mark.parametrize("query", QUERIES)
def test_rank_against_all_stretches(spark, query):
    rows = texts(1, 40)
    got = {r.id: r.rank for r in spark.createDataFrame(rows, KIND).select("id", cover_rank(query, F.col("content")).alias("rank")).collect()}
    assert got == pytest.approx({i: brute(query, t) for i, t in rows})


def test_index_gives_what_the_texts_give(spark):
    index = TextIndex(spark, folder(spark, "texts"), buckets=8)
    now = {}
    for k in range(4):
        batch = texts(k, 30, 100 * k)
        index.add(spark.createDataFrame(batch, KIND))
        now |= dict(batch)
    gone = [i for i in now if i % 7 == 3]
    index.remove(spark.createDataFrame([(i,) for i in gone], "id long"))
    now = {i: t for i, t in now.items() if i not in gone}
    change = [(5, "a b a b"), (gone[0], "c d a"), (777, "b")]
    index.replace(spark.createDataFrame(change, KIND))
    now |= dict(change)
    table = spark.createDataFrame(list(now.items()), KIND)
    for query in QUERIES:
        want = {r.id: brute(query, r.content) for r in table.where(matches(query, F.col("content"))).collect()}
        assert {r.id: r.rank for r in index.search(query).collect()} == pytest.approx(want), query
    index.add(spark.createDataFrame(texts(9, 200, 2000), KIND))
    m = index.manifest()
    assert len(m["segments"]) == 1 and not m["gone"] and m["segments"][0]["texts"] == len(now) + 202
    assert {r.id for r in index.search("c d").collect() if r.id < 2000} == {r.id for r in table.where(matches("c d", F.col("content"))).collect()}


def test_only_the_words_folders_are_read(spark):
    index = TextIndex(spark, folder(spark, "texts"), buckets=16)
    index.add(spark.createDataFrame([(k, f"common w{k} w{k + 1}") for k in range(200)], KIND))
    rows = index._postings(index.manifest(), ["w7", "w8"], index.manifest()["segments"])
    assert {r.id for r in rows.collect()} == {6, 7, 8} and len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) <= 2
    whole = index._postings(index.manifest(), None, index.manifest()["segments"]).inputFiles()
    assert len(rows.inputFiles()) <= len(whole) // 4


def test_empty_tables(spark):
    index = TextIndex(spark, folder(spark, "texts"))
    assert index.search("a").count() == 0
    index.add(spark.createDataFrame([], KIND))
    assert index.search("a").count() == 0 and index.manifest()["segments"] == []

import random

from pyspark.sql import functions as F

from engram.llm.queries import RULES
from engram.llm.urlfilter import judge_urls, url_parts


def test_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "ftp://b.net/es/1", "x://net/fr/2", "http://notexample.com/en/", "http://host", "http://host?x/y", "no scheme/com/", "", None, "a://b://c/d", "http://É.com/p"]
    df = spark.createDataFrame([(k, u, "z", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, bad int")
    got = {r.page_id: r for r in judge_urls(df, spark.createDataFrame([], "doc_id long, bad int"), RULES).collect()}
    assert [(got[k].host, got[k].path) for k in range(12)] == [
        ("a.example.com", "/en/x"), ("www.example.com", "/en/"), ("b.net", "/es/1"), ("net", "/fr/2"), ("notexample.com", "/en/"), ("host", ""), ("host", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("É.com", "/p"),
    ]
    assert [got[k].rule for k in range(12)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", "com/", None, None, None, None, None, None, "com/"]
    assert [got[k].verdict for k in range(4)] == ["block", "allow", "block", "block"]
    assert judge_urls(df.limit(0), df.select("page_id", "bad"), RULES).count() == 0


def test_templates(spark):
    r = random.Random(1)
    rows = [(k, f"http://h.org/blog/{r.randrange(10**6)}/post") for k in range(300)] + [(300 + k, f"http://h.org/{r.choice(['casino', 'blog2', 'news'])}/{r.randrange(10**6)}") for k in range(600)]
    rows += [(rows[0][0], rows[0][1]), (None, "http://h.org/blog/1/post")]
    labels = [(k, int("casino" in u)) for k, u in rows if k is not None and k % 2] + [(1, None), (10**9, 1)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int"))
    by = {x.template: x for x in got.groupBy("template").agg(F.min("verdict").alias("low"), F.max("verdict").alias("high"), F.count("*").alias("n")).collect()}
    assert by["/casino/*"].low == by["/casino/*"].high == "block" and all(x.low == x.high == "allow" for t, x in by.items() if t != "/casino/*")
    assert sum(x.n for x in by.values()) == len(rows) and max(x.n for t, x in by.items() if t != "/casino/*") >= 300


def test_url_parts_of_long_urls(spark):
    host, path = url_parts(F.col("u"))
    row = spark.createDataFrame([("http://x.y/" + "a/" * 50_000,)], "u string").select(host.alias("h"), F.length(path).alias("n")).first()
    assert tuple(row) == ("x.y", 100_001)


def test_deep_paths_and_single_branches(spark):
    """Levels beyond the fourth are judged; one branch among siblings that differ isn't merged; few pages aren't divided."""
    rows = [(k, f"http://d.org/a/b/c/{2000 + k % 20}/{'bad' if k % 2 else 'good'}/{k}/x") for k in range(400)]
    rows += [(1000 + k, f"http://e.org/{('all-bad', 'mixed', 'all-good')[k % 3]}/{k}") for k in range(300)] + [(2000 + k, "http://f.org/" + "s/" * 300) for k in range(3)]
    labels = [(k, k % 2) for k in range(400)] + [(1000 + k, (1, k % 2, 0)[k % 3]) for k in range(300)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int"), lift=1.5).collect()
    by = {r.page_id: r for r in got}
    assert by[1].template == "/a/b/c/*/bad/*/x" and by[1].verdict == "block" and by[0].template == "/a/b/c/*/good/*/x" and by[0].verdict == "allow"
    assert {by[1000 + k].template for k in range(3)} == {"/all-bad/*", "/mixed/*", "/all-good/*"} and [by[1000 + k].verdict for k in range(3)] == ["block", "allow", "allow"]
    assert by[2000].template == "/**"

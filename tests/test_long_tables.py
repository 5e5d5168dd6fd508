"""Steps whose groups are few: what one task or row holds stays bounded as the tables grow."""

import random
import re

from pyspark.sql import functions as F

from engram.operators.windows import adaptive_threshold, in_slices
from engram.plans import sources
from engram.plans.views import Tables
from engram.streaming import jobs


def loop(oks, value=75, low=50, high=95):
    for ok in oks:
        value = min(high, max(low, value + (-2 if ok else 2)))
    return value / 100


def test_files_are_bounded(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    for values, events in ((sources._activity_files(t), t.events), (sources._highlight_pages(t), t.interactions)):
        sizes = [len(re.findall('"time":|"highlighted_at":', r.value)) for r in values.select("value").collect()]
        assert max(sizes) <= 1000 and sum(sizes) == events.count() > 5000


def test_a_key_is_dealt_over_tasks(spark):
    r = random.Random(6)
    oks = [r.random() < (0.2 if n < 5000 else 0.6) for n in range(20000)]
    order = random.Random(7).sample(range(20000), 20000)
    rows = spark.createDataFrame([(n, "k", oks[n]) for n in order], "n long, key string, ok boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = in_slices(rows, ["key"], ["n"]).groupBy("_slice").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("rows")).orderBy("_slice").collect()
        assert len(cut) > 4 and max(c.rows for c in cut) < 10000 and all(x.b < y.a for x, y in zip(cut, cut[1:]))
        got = adaptive_threshold(rows, "key", ["n"], "ok")
        assert [(x.threshold, x.outcomes) for x in got.collect()] == [(loop(oks), 20000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_steps_are_composed_before_the_state(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"2024-01-{1 + n // 1000:02d} {n // 50 % 20:02d}:{n % 50:02d}:00", n, "xy"[n % 2], r.random() < 0.45) for n in range(6000)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "ts string, event_id long, kind string, ok boolean")
    for k, (name, time) in enumerate((("text", F.col("ts")), ("instant", F.to_timestamp("ts")), ("local", F.col("ts").cast("timestamp_ntz")))):
        path = str(tmp_path / name)
        df.withColumn("ts", time).repartition(4).write.parquet(path)
        stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema)
        jobs.run_once(jobs.thresholds(stream, "kind", "ok"), name=f"composed{k}", mode="update")
        got = {x.kind: (x.threshold, x.outcomes) for x in spark.table(f"composed{k}").collect()}
        assert got == {kind: (loop([ok for *_, which, ok in rows if which == kind]), 3000) for kind in "xy"}
    assert "MapInPandas" in jobs.thresholds(stream, "kind", "ok")._jdf.queryExecution().analyzed().toString()


def test_chains_of_any_length(spark):
    """A chain of 5,000, branches of three conversations at once, a cycle and a missing parent."""
    from engram.operators.graph import above, parent_chain

    n = 5000
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, n)], "node long, parent long")
    got = {r.node: r.place for r in parent_chain(chain, n - 1).collect()}
    assert got == {k: k for k in range(n)}
    assert [(r.node, r.place) for r in parent_chain(chain, 0).collect()] == [(0, 0)]
    rows = [(c, f"n{k}", f"n{k - 1}" if k else None) for c in "ab" for k in range(150)] + [("a", "x", "n149"), ("a", "y", "n3"), ("c", "p", "q"), ("c", "q", "p"), ("c", "r", "p"), ("d", "s", None)]
    links = spark.createDataFrame(rows, "conv string, node string, parent string")
    starts = spark.createDataFrame([("a", "x"), ("b", "n70"), ("c", "r"), ("d", "s")], "conv string, node string")
    got = {(r.conv, r.node): r.place for r in above(links, starts, ["conv"]).collect()}
    assert got == {("a", "x"): 150, ("d", "s"): 0} | {("a", f"n{k}"): k for k in range(150)} | {("b", f"n{k}"): k for k in range(71)}

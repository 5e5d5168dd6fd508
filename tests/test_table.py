import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.operators.cut import folder
from engram.operators.table import EDGES, THOUGHTS, Conflict, KeyedTable, WorkQueue, remove_rows, sink, store_edges, store_rows, store_thoughts

KIND = "id bigint, v string"


def made(spark, name="table", **kw):
    return KeyedTable(spark, folder(spark, name), KIND, ["id"], **kw)


def rows(spark, a, b, v):
    return spark.createDataFrame([(k, v) for k in range(a, b)], KIND)


def content(table, version=None):
    return sorted((r.id, r.v) for r in table.read(version).collect())


def test_replaces_inserts_and_deletes(spark):
    t = made(spark, buckets=4)
    assert content(t) == []
    store_rows(t, rows(spark, 0, 40, "a"))
    store_rows(t, rows(spark, 30, 50, "b"))
    assert content(t) == [(k, "a" if k < 30 else "b") for k in range(50)] and content(t, 1) == [(k, "a") for k in range(40)]
    store_rows(t, rows(spark, 45, 55, "c"), replace=False)
    remove_rows(t, rows(spark, 0, 44, ""))
    assert content(t) == [(k, "b" if k < 50 else "c") for k in range(44, 55)]
    store_rows(t, spark.createDataFrame([(None, "n"), (None, "m"), (44, None)], KIND))
    assert {(r.id, r.v) for r in t.read().collect()} >= {(None, "m"), (44, None)}
    remove_rows(t, spark.createDataFrame([(None,)], "id bigint"))
    version = t.manifest()["version"]
    assert t.merge(rows(spark, 0, 0, ""), lambda s, c: s)["version"] == version and t.read().count() == 11
    t.vacuum()
    assert t.versions() == [version] and t.read().count() == 11 and len(t._names("runs")) <= 4 and not t._names("intents")
    with pytest.raises(ValueError, match="4 buckets"):
        KeyedTable(spark, t.path, KIND, ["id"], 8).read()


def test_only_touched_buckets_are_read_and_written(spark):
    t = made(spark, buckets=16)
    store_rows(t, rows(spark, 0, 1600, "a"))
    before = t.manifest()
    few = rows(spark, 5, 7, "b")
    seen = []
    after = t.merge(few, lambda stored, new: (seen.append(stored), stored.join(new, "id", "left_anti").unionByName(new))[1])
    changed = {b for b in after["runs"] if after["runs"][b] != before["runs"][b]}
    assert 1 <= len(changed) <= 2 and sum(after["rows"].values()) == 1600
    assert {f.split("_bucket=")[1].split("/")[0] for f in seen[0].inputFiles()} == changed
    new = set(after["runs"].values()) - set(before["runs"].values())
    assert len(new) == 1 and sum(len(os.listdir(f"{t.path.removeprefix('file://')}/runs/{r}")) for r in new) <= len(changed) + 2
    assert {f.split("_bucket=")[1].split("/")[0] for f in t.read(keys=few).inputFiles()} == changed


def test_repeated_batches_and_killed_writers(spark):
    t = made(spark)
    store_rows(t, rows(spark, 0, 5, "a"), ("s", 0))
    store_rows(t, rows(spark, 5, 9, "b"), ("s", 1))
    for number in (0, 1):
        assert store_rows(t, rows(spark, 0, 9, "again"), ("s", number))["version"] == 2
    store_rows(t, rows(spark, 0, 1, "other"), ("r", 0))
    assert content(t) == [(0, "other"), *((k, "a" if k < 5 else "b") for k in range(1, 9))]
    orphan, _ = t._write(rows(spark, 0, 100, "dead"), 100)
    assert t.read().count() == 9
    t.vacuum()
    assert orphan in {x.getPath().getName() for x in t._names("runs")}
    t.vacuum(grace_seconds=-1)
    assert orphan not in {x.getPath().getName() for x in t._names("runs")} and t.read().count() == 9
    with pytest.raises(Conflict):
        t.commit(t.manifest())


def test_writers_at_once(spark):
    path = folder(spark, "counts")
    kind = "id bigint, n bigint"
    make = lambda: KeyedTable(spark, path, kind, ["id"], 4)
    add = lambda stored, new: stored.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))

    def work(k):
        for number in range(3):
            make().merge(spark.range(20).select("id", F.lit(10**k).cast("bigint").alias("n")), add, (f"w{k}", number))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert {r.n for r in make().read().collect()} == {333} and make().manifest()["version"] == 9 and make().read().count() == 20


def test_thoughts_and_edges(spark):
    t = KeyedTable(spark, folder(spark, "thoughts"), THOUGHTS, ["fingerprint"], 4)
    kind = "content string, metadata map<string,string>, seq bigint"
    for number, batch in enumerate(([("Same  text", {"a": "1", "b": "1"}, 1), ("other", {}, 2)], [("same text ", {"b": "2"}, 1), ("SAME TEXT", {"c": "3"}, 2)], [("other", None, 1)])):
        for _ in range(2):
            store_thoughts(t, spark.createDataFrame(batch, kind), ("import", number))
    got = {r.content: (r.metadata, r.writes) for r in t.read().collect()}
    assert got == {"Same  text": ({"a": "1", "b": "2", "c": "3"}, 3), "other": ({}, 2)}
    e = KeyedTable(spark, folder(spark, "edges"), EDGES, ["from_id", "to_id", "relation"], 4)
    for _ in range(2):
        store_edges(e, spark.createDataFrame([(1, 2, "r", 0.5), (2, 1, "r", 0.7), (3, None, "r", 1.0)], "from_id bigint, to_id bigint, relation string, confidence double"), symmetric=True)
    assert [tuple(r) for r in e.read().collect()] == [(1, 2, "r", 4, 0.7)]


def test_workers_never_share_an_item(spark):
    path = folder(spark, "queue")
    WorkQueue(spark, path, 4).put(spark.range(40).select("id", (100 - F.col("id")).alias("queued_at")))
    taken = {k: [] for k in range(3)}

    def work(k):
        while got := WorkQueue(spark, path, 4).claim(f"w{k}", 6, now=1000, lease=50):
            taken[k] += got

    threads = [threading.Thread(target=work, args=(k,)) for k in taken]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert Counter(i for ids in taken.values() for i in ids) == Counter(range(40))
    q = WorkQueue(spark, path, 4)
    assert {(r.id, r.worker) for r in q.read().collect()} == {(i, f"w{k}") for k, ids in taken.items() for i in ids}


def test_leases_outcomes_and_attempts(spark):
    q = WorkQueue(spark, folder(spark, "queue"), 4, most_attempts=2)
    kind = "id bigint, outcome string, error string"
    q.put(spark.createDataFrame([(k, k) for k in range(6)], "id bigint, queued_at bigint"))
    assert q.claim("dead", 3, now=0, lease=10) == [0, 1, 2] and q.claim("b", 2, now=9, lease=100) == [3, 4]
    assert q.claim("c", 9, now=10, lease=100) == [0, 1, 2, 5]  # the dead one's items are back
    q.settle("dead", spark.createDataFrame([(0, "complete", None)], kind), now=11)
    q.settle("c", spark.createDataFrame([(0, "complete", None), (1, "error", "x" * 900), (2, "release", None), (3, "complete", None)], kind), now=12)
    state = {r.id: (r.status, r.attempts, r.worker) for r in q.read().collect()}
    assert state == {0: ("complete", 0, "c"), 1: ("pending", 1, None), 2: ("pending", 0, None), 3: ("processing", 0, "b"), 4: ("processing", 0, "b"), 5: ("processing", 0, "c")}
    assert q.claim("c", 1, now=20, lease=5) == [1]
    q.settle("c", spark.createDataFrame([(1, "error", "again")], kind), now=21)
    q.put(spark.createDataFrame([(0, 77), (2, 99), (4, 99)], "id bigint, queued_at bigint"))
    rows = {r.id: (r.status, r.attempts, r.last_error, r.queued_at) for r in q.read().collect()}
    assert rows[1] == ("failed", 2, "again", 1) and rows[0] == ("pending", 0, None, 77) and rows[2][3] == 2 and rows[4][0] == "processing"


def test_stream_that_starts_again(spark):
    """Without its checkpoint's last commit a batch comes twice, and is stored once."""
    base = folder(spark, "stream")
    t = KeyedTable(spark, f"{base}/table", "id bigint, n bigint", ["id"], 4)
    add = lambda table, rows, batch: table.merge(rows, lambda stored, new: stored.unionByName(new).groupBy("id").agg(F.sum("n").alias("n")), batch)
    spark.range(10).select("id", F.lit(1).cast("bigint").alias("n")).coalesce(1).write.parquet(f"{base}/in")
    run = lambda: spark.readStream.schema("id bigint, n bigint").parquet(f"{base}/in").writeStream.foreachBatch(sink(t, add, "s")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    run()
    commits = f"{base.removeprefix('file://')}/checkpoint/commits"
    for name in os.listdir(commits):
        if name.lstrip(".").split(".")[0] == "0":
            os.remove(f"{commits}/{name}")
    run()
    assert {r.n for r in t.read().collect()} == {1} and t.manifest()["batches"] == {"s": 0} and t.read().count() == 10
    spark.range(5).select("id", F.lit(1).cast("bigint").alias("n")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert sorted((r.id, r.n) for r in t.read().collect()) == [(k, 2 if k < 5 else 1) for k in range(10)]

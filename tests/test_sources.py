import io
import json
import zipfile

from pyspark.sql import functions as F

from engram.plans.sources import workbook
from engram.sources import exports, importers
from engram.streaming import jobs


def test_files_are_read(spark, tmp_path):
    (tmp_path / "vault" / ".obsidian").mkdir(parents=True)
    (tmp_path / "vault" / "a.md").write_text("---\ntitle: Äpfel\norder: 2\n---\n# Head\nSee [[B]] #fruit\n```\n#no\n```\n")
    (tmp_path / "vault" / "b.md").write_text("plain words only")
    (tmp_path / "vault" / ".obsidian" / "c.md").write_text("hidden")
    files = importers.read_texts(spark, str(tmp_path / "vault"), "*.md")
    got = {r.path.rsplit("/", 1)[1]: r for r in importers.notes(files).collect()}
    assert got.keys() == {"a.md", "b.md"} and got["a.md"].front == {"title": "Äpfel", "order": "2"} and got["a.md"].links == ["B"] and got["a.md"].tags == ["fruit"] and got["b.md"].front == {}
    (tmp_path / "book.xlsx").write_bytes(workbook({"Memory": [["content", "deleted"], ["x & y", "true"], ["", "1"]], "Other": []}))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = importers.perplexity_memories(importers.read_binaries(spark, str(tmp_path), "*.xlsx")).collect()
    assert [(r.content, r.deleted, r.forgotten) for r in rows] == [("x & y", True, False)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x/conversations-001.json", "﻿" + json.dumps([{"id": "c", "mapping": {}}]))
        z.writestr("other.txt", "z")
    (tmp_path / "e.zip").write_bytes(out.getvalue())
    assert importers.unzipped(importers.read_binaries(spark, str(tmp_path), "*.zip"), r"conversations(-\d+)?\.json$").count() == 1
    (tmp_path / "feed.xml").write_text("<feed><entry><title>t</title><content>&lt;p&gt;a long enough paragraph&lt;/p&gt;</content></entry><entry><title>u</title><content>short</content></entry></feed>")
    assert [r.text for r in importers.read_blog(spark, str(tmp_path / "feed.xml")).collect()] == ["a long enough paragraph"]


def test_broken_input_gives_no_rows(spark):
    bad = spark.createDataFrame([("p/x/y.json", "{not json"), ("q", None), ("r", "")], "path string, value string")
    for f in (importers.chatgpt_nodes, importers.activities, importers.instagram_messages, importers.tweets, importers.highlights):
        assert f(bad).count() == 0
    assert importers.grok_conversations(bad).where("id IS NOT NULL OR at IS NOT NULL").count() == 0
    assert [r.body for r in importers.mail_text(bad).collect()] == [None, None, None]


def test_branch_without_a_current_node(spark):
    rows = [("c", None, "a", None, "user", "hi", 1.0), ("c", None, "b", "a", "assistant", "old", 2.0), ("c", None, "d", "a", "assistant", "new", 3.0)]
    got = importers.canonical_branch(spark.createDataFrame(rows, "conv string, current string, node string, parent string, role string, text string, at double"))
    assert [(r.place, r.node) for r in got.orderBy("place").collect()] == [(0, "a"), (1, "d")]


def test_backup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n\"b\""), (2, None)], "id long, text string")
    exports.backup({"t": df}).write.partitionBy("table").text(str(tmp_path / "b"))
    lines = spark.read.text(str(tmp_path / "b")).withColumnRenamed("value", "line")
    assert sorted(map(tuple, exports.restore(lines, {"t": "id long, text string"})["t"].collect())) == [(1, "a\n\"b\""), (2, None)]


def test_captures_and_sessions(spark, tmp_path):
    rows = [("1.0", "2024-01-01 10:00:00", "c", None, None, "a"), ("1.0", "2024-01-01 10:00:01", "c", None, None, "a"), ("1.1", "2024-01-01 10:01:00", "c", "bot_message", None, "x"), ("1.2", "2024-01-01 10:02:00", "d", None, None, "x"), ("1.3", "2024-01-01 18:00:00", "c", None, None, " "), ("1.4", "2024-01-01 18:00:00", "c", None, None, "b")]
    df = spark.createDataFrame(rows, "slack_ts string, t string, channel string, subtype string, bot_id string, text string").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_stream(spark, str(tmp_path / "in"), df.schema)
    jobs.run_once(jobs.captures(stream(), "c"), name="captures")
    assert sorted(r.slack_ts for r in spark.table("captures").collect()) == ["1.0", "1.4"]
    jobs.run_once(jobs.event_sessions(stream(), "channel"), name="sessions")
    assert sorted((r.channel, r.events) for r in spark.table("sessions").collect()) == [("c", 3), ("d", 1)]
    jobs.run_once(jobs.rate_limited(stream().where("channel = 'c'"), "channel", 1), name="limited")
    assert {r.events for r in spark.table("limited").collect()} == {2}


def test_sinks_can_be_run_again(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, content string")
    write = jobs.once_by_key(str(tmp_path / "out"), "id")
    for _ in range(2):
        write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    queue = jobs.enqueue_changes(str(tmp_path / "known"), str(tmp_path / "queue"))
    for number, rows in enumerate(([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")])):
        for _ in range(2):
            queue(spark.createDataFrame(rows, "id long, content string"), number)
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "queue")).collect()
    assert sorted((r.batch, r.id) for r in got) == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_thresholds_over_batches(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(f"2024-01-0{n + 1} 00:00:0{k}", 10 * n + k, "x", k % 2 == 0) for k in range(5)], "ts string, event_id long, kind string, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    jobs.run_once(jobs.thresholds(stream, "kind", "ok"), name="thresholds", mode="update")
    assert sorted((r.outcomes, r.threshold) for r in spark.table("thresholds").collect()) == [(5, 0.73), (10, 0.71), (15, 0.69)]


def test_pages_are_followed(spark, tmp_path):
    from engram.sources.rest import register

    pages = {"inbox-": {"messages": [{"id": "1"}, {"id": "2"}], "token": "b"}, "inbox-b": {"messages": [{"id": "3"}]}, "sent-": {"messages": [], "token": None}}
    for name, page in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(page))
    register(spark)
    got = spark.read.format("paged").options(url=f"file://{tmp_path}/{{start}}-{{cursor}}.json", starts="inbox,sent", items="messages", next="token").load().collect()
    assert sorted((r.start, json.loads(r.value)["id"]) for r in got) == [("inbox", "1"), ("inbox", "2"), ("inbox", "3")]

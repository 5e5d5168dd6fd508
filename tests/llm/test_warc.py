import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from engram.llm.shared import shared_dir
from engram.llm.warc import FIRST_PAGE, PAGE, PROFILE, WarcReader, archive_pages, read_warc, record


def pages(spark):
    long = "é" * 60_000 + "<p>"
    rows = [(1, "http://a", "short"), (2, "http://b", "short"), (3, "u\r\nv", long), (4, None, long), (5, "http://c", None), (6, "http://d", "x" * 100), (7, "http://e", "x" * 100), (7, "http://e", "x" * 100), (None, "http://n", "x" * 100), (8, "", "y" * 99), (9, "", "y" * 99)]
    return rows, spark.createDataFrame([(*r, b"z", "q") for r in rows], "page_id long, url string, html string, payload binary, digest string")


def test_round_trip(spark):
    rows, df = pages(spark)
    path = archive_pages(df.repartition(3))
    got = read_warc(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(int(r.headers[PAGE]) if PAGE in r.headers else None, []).append(r)
    for i, _, html in rows:
        payload = (html or "").encode()
        for r in by[i]:
            assert r.payload_digest == "sha256:" + hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload)
            assert bytes(r.payload or b"") == (payload if r.record_type == "response" else b"")
            assert (r.headers.get("warc-profile") == PROFILE) == (r.record_type == "revisit")
    kinds = {k: v[0].record_type for k, v in by.items()}
    assert kinds[4] == kinds[7] == kinds[None] == "revisit" and list(kinds.values()).count("revisit") == 3
    assert by[4][0].headers[FIRST_PAGE] == "3" and by[4][0].refers_to == by[3][0].record_id and by[3][0].target_uri == "u%0D%0Av"
    assert len({r.record_id for r in got}) == len(got)
    assert archive_pages(df.limit(0)) and read_warc(spark, archive_pages(df.limit(0))).count() == 0


def test_filters_and_unread_payloads(spark):
    _, df = pages(spark)
    path = archive_pages(df)
    found = read_warc(spark, path)
    assert found.where("record_type = 'revisit'").count() == 4
    assert read_warc(spark, path, payloads=False).where("record_type = 'response' AND payload IS NULL").count() == 7


def test_pushed_filters_agree_with_unpushed_ones(spark):
    _, df = pages(spark)
    path = archive_pages(df)
    rows = spark.createDataFrame(read_warc(spark, path).collect(), read_warc(spark, path).schema)
    for where in ("target_uri = 'http://a'", "target_uri IN ('http://a', 'http://c', NULL)", "refers_to IN ('x', NULL)", "target_uri = NULL", "target_uri IN (NULL)", "refers_to IS NULL", "target_uri IS NULL OR record_type = 'revisit'",
                  "headers['x-page-id'] = '7'", "headers['X-Page-Id'] = '7'", "NOT (target_uri IN ('http://a', NULL))", "record_type = 'revisit' AND target_uri IN ('http://e', '', NULL)"):
        pushed = sorted(r.record_id for r in read_warc(spark, path, payloads=False).where(where).collect())
        assert pushed == sorted(r.record_id for r in rows.where(where).collect()), where
    reader = WarcReader({"path": path})
    assert list(reader.pushFilters([EqualTo(("target_uri",), "http://a"), In(("record_type",), ("response", None)), In(("payload_bytes",), (1,))])) == [In(("payload_bytes",), (1,))]
    assert [r[2] for p in reader.partitions() for r in reader.read(p)] == ["http://a"]


def test_foreign_files(spark, tmp_path):
    one = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:1>"}, b"a\r\n\r\nb" * 30_000)
    two = record({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:2>"}, b"")
    (tmp_path / "plain.warc").write_bytes(one + two)
    (tmp_path / "zipped.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == [("<urn:1>", 180_000)] * 2 + [("<urn:2>", 0)] * 2
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_later_writes_add_or_replace(spark):
    make = lambda a, b: spark.createDataFrame([(k, f"http://{k}", "p" * k) for k in range(a, b)], "page_id long, url string, html string")
    pages_of = lambda path: sorted(int(r.headers[PAGE]) for r in read_warc(spark, path).collect())
    path = archive_pages(make(1, 5).repartition(2))
    archive_pages(make(5, 7), path)
    assert pages_of(path) == [1, 2, 3, 4, 5, 6]
    once = read_warc(spark, archive_pages(make(20, 23)))
    once.write.format("warc").mode("append").save(path)
    assert pages_of(path) == [1, 2, 3, 4, 5, 6, 20, 21, 22]
    once.write.format("warc").mode("overwrite").save(path)
    files = os.listdir(path.removeprefix("file://"))
    assert pages_of(path) == [20, 21, 22] and sum(x.startswith("_committed") for x in files) == 1 and sum(x.endswith(".warc.gz") for x in files) <= 3


def test_failed_tasks_leave_nothing(spark):
    path = archive_pages(spark.createDataFrame([(1, "u", "p")], "page_id long, url string, html string"))
    before = sorted(os.listdir(path.removeprefix("file://")))
    bad = read_warc(spark, path).withColumn("payload", F.when(F.rand() >= 0, F.raise_error(F.lit("lost")).cast("binary")))
    good = read_warc(spark, path)
    with pytest.raises(Exception, match="lost"):
        good.union(bad).coalesce(1).write.format("warc").mode("append").save(path)
    assert sorted(os.listdir(path.removeprefix("file://"))) == before

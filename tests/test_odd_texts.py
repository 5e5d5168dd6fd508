"""Queries over tables whose texts are empty, blank, null or look like what a query itself makes of them, beside their SQL."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from engram.plans import all_queries
from engram.plans.sources import workbook
from engram.sources import importers
from tests.oracle import compare, duck

QUERIES, SQL = all_queries()
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  \n ", "\n", "\t", "a\r\nb e", "\r", "  e  ", "　e", "\xa0e\xa0", "=5=", "e\n=77=\ne", "=\xb2=", "\x0be\x0b", "\x1ce\x1d", "😀 e", "<b>e</b> &amp; &lt; &nbsp;", "_x0041_ e", "e" * 7000, "]]> e", "￾e", None]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The tables with odd texts in every other document: an entity, day or week may have no other."""
    folder = tmp_path_factory.mktemp("odd")
    for f in os.listdir(SF):
        t = pq.read_table(f"{SF}/{f}")
        if f == "documents.parquet":
            texts = t.column("text").to_pylist()
            for k in range(0, len(texts), 2):
                texts[k] = ODD[k // 2 % len(ODD)]
            t = t.set_column(t.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        pq.write_table(t, folder / f)
    return str(folder)


def same(spark, odd, name):
    assert compare(QUERIES[name](spark, odd), duck(odd).sql(SQL[name])) is None


@pytest.mark.parametrize("name", ["f05_entity_summaries", "f05_period_summaries", "f05_summary_trees"])
def test_summaries_of_odd_texts(spark, odd, name):
    same(spark, odd, name)


def test_days_without_a_source(spark, tmp_path):
    from engram.operators.summaries import period_material

    rows = spark.sql("SELECT timestamp_ntz'2024-01-02 03:00:00' AS at, 'text' AS text, CAST(NULL AS string) AS cat")
    got = [(r.key, r.title) for r in period_material(rows, "day", "at", "text", rows["cat"]).collect()]
    assert got == [(None, "day ?")]


@pytest.mark.parametrize("name", ["s08_workbook_conversations", "s09_workbook_memories", "s20_workbook_tables"])
def test_workbooks_of_odd_texts(spark, odd, name):
    same(spark, odd, name)


def test_cells_without_a_value(spark):
    """An empty text is a content, a cell without a value isn't; a row with both flags is an entry all the same."""
    memory = [["content", "deleted", "forgotten"], ["", "1", "0"], [None, "1", None], [None, "1", "0"], ["", "", None], ["a\r_x000D_", "no", "no"]]
    talk = [["uuid", "title", "query"], ["u", "", ""], ["", None, "no head"]]
    files = spark.createDataFrame([("p", workbook({"Memory": memory, "Conversations": talk}, blank=None))], "path string, content binary")
    got = importers.perplexity_memories(files).orderBy("place").collect()
    assert [(r.content, r.deleted, r.forgotten) for r in got] == [("", True, False), (None, True, False), ("", False, False), ("a\r_x000D_", False, False)]
    assert [(r.uuid, r.title, r.query, r.answer) for r in importers.perplexity_conversations(files).collect()] == [("u", "", "", None)]


def test_mails_of_odd_texts(spark, odd):
    same(spark, odd, "s12_mail_text")


def test_empty_parts_of_mails(spark):
    """An empty part gives way to one with text, and is an empty body if there is none; a message without parts has no body."""
    part = lambda kind, data: {"mimeType": f"text/{kind}", "body": {"data": data}}
    mails = [[part("plain", ""), part("html", "PGI-aGk8L2I-")], [part("plain", ""), {"parts": [part("plain", "eA")]}], [part("html", "")], [part("html", "JmFtcDtsdDs")], [], [part("plain", None)]]
    rows = spark.createDataFrame([(k, json.dumps({"payload": {"mimeType": "multipart/mixed", "parts": m}})) for k, m in enumerate(mails)], "k int, value string")
    assert [r.body for r in importers.mail_text(rows).orderBy("k").collect()] == ["hi", "x", "", "&lt;", None, None]

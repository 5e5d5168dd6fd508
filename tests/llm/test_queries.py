import pytest

from engram.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op12_embedding_whitening"}))
def test_one_row_for_each_document(spark, con, name):
    rows = [r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(rows) == sorted(r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall())


def test_language_of_held_out_documents(spark):
    got = QUERIES["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)

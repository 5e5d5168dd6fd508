"""Views of the given tables as a memory store: thoughts, entities, edges, memories, contacts and so on, in both dialects.

Each view is a pair of equal definitions: one for Spark and one for the SQL that results are checked against. Clocks are
literals, never the current time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-03-01 00:00:00"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """The tables of a folder and the views over them, by name: t.documents, t.thoughts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name][0](self)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_TYPE = _case("doc_id % 8", ["idea", "task", "person_note", "reference", "decision", "lesson", "meeting", "journal"])
_STATUS = "CASE WHEN doc_id % 8 IN (0, 1) THEN " + _case("doc_id % 5", ["new", "planning", "active", "review", "done"]) + " END"
_TIER = "CASE doc_id % 10 WHEN 0 THEN 'restricted' WHEN 1 THEN 'personal' WHEN 2 THEN NULL ELSE 'standard' END"


def _thoughts(t: Tables) -> DataFrame:
    return t.documents.selectExpr(
        "doc_id AS id", "text AS content", "source AS source_type", "lang", f"{_TYPE} AS type", "doc_id % 101 AS importance", "(doc_id * 37) % 101 AS quality_score", f"{_TIER} AS sensitivity_tier", f"{_STATUS} AS status",
        "IF(doc_id % 13 = 0, CAST(array() AS array<string>), array(concat('t', doc_id % 7), concat('u', doc_id % 11))) AS topics",
        "IF(doc_id % 3 = 0, array(concat('p', doc_id % 5)), CAST(array() AS array<string>)) AS people",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS int)) AS created_at",
        "IF(doc_id >= 3, array(doc_id div 2, doc_id div 3), CAST(array() AS array<bigint>)) AS derived_from",
    )


_THOUGHTS = f"""SELECT doc_id AS id, text AS content, source AS source_type, lang, {_TYPE} AS type, doc_id % 101 AS importance, (doc_id * 37) % 101 AS quality_score,
  {_TIER} AS sensitivity_tier, {_STATUS} AS status,
  CASE WHEN doc_id % 13 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['t' || doc_id % 7, 'u' || doc_id % 11] END AS topics,
  CASE WHEN doc_id % 3 = 0 THEN ['p' || doc_id % 5] ELSE CAST([] AS VARCHAR[]) END AS people,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (doc_id) HOUR AS created_at,
  CASE WHEN doc_id >= 3 THEN [doc_id // 2, doc_id // 3] ELSE CAST([] AS BIGINT[]) END AS derived_from
FROM documents"""


def _metadata(t: Tables) -> DataFrame:
    """Thoughts with their metadata as a JSON object."""
    return t.thoughts.withColumn("metadata", F.to_json(F.struct("type", "topics", "people", F.col("source_type").alias("source"), F.struct("lang", F.col("quality_score").alias("score")).alias("origin"))))


_METADATA = "SELECT *, to_json({'type': type, 'topics': topics, 'people': people, 'source': source_type, 'origin': {'lang': lang, 'score': quality_score}}) AS metadata FROM thoughts"


def _vectors(t: Tables) -> DataFrame:
    return t.thoughts.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label"), "id")


_VECTORS = "SELECT thoughts.*, embedding, label FROM thoughts JOIN embeddings ON vec_id = id"


def _thought_entities(t: Tables) -> DataFrame:
    """All lines with whole part keys, so that the thoughts of an entity stay few as the tables grow."""
    return t.lineitem.selectExpr("CAST(l_orderkey AS bigint) AS thought_id", "CAST(l_partkey AS bigint) AS entity_id").distinct()


_THOUGHT_ENTITIES = "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS thought_id, CAST(l_partkey AS BIGINT) AS entity_id FROM lineitem"
_KIND = _case("p_partkey % 6", ["person", "project", "topic", "tool", "organization", "place"])


def _entities(t: Tables) -> DataFrame:
    return t.part.selectExpr("CAST(p_partkey AS bigint) AS entity_id", "p_name AS canonical_name", f"{_KIND} AS entity_type")


_ENTITIES = f"SELECT CAST(p_partkey AS BIGINT) AS entity_id, p_name AS canonical_name, {_KIND} AS entity_type FROM part"


_RELATION = _case("l_linenumber % 6", ["works_on", "uses", "related_to", "member_of", "located_in", "co_occurs_with"])


def _mentions(t: Tables) -> DataFrame:
    """One row for each time that an edge between two entities was seen."""
    return t.lineitem.selectExpr(
        "CAST(l_partkey AS bigint) AS from_id", "CAST(l_suppkey AS bigint) AS to_id", f"{_RELATION} AS relation", "CAST(l_linenumber % 10 AS double) / 10 AS confidence", "CAST(l_orderkey AS bigint) AS seen", "CAST(l_linenumber AS bigint) AS nth",
    ).where("from_id <> to_id")


_MENTIONS = f"""SELECT * FROM (SELECT CAST(l_partkey AS BIGINT) AS from_id, CAST(l_suppkey AS BIGINT) AS to_id, {_RELATION} AS relation,
  CAST(l_linenumber % 10 AS DOUBLE) / 10 AS confidence, CAST(l_orderkey AS BIGINT) AS seen, CAST(l_linenumber AS BIGINT) AS nth FROM lineitem) WHERE from_id <> to_id"""


def _edges(t: Tables) -> DataFrame:
    from engram.operators.upsert import upsert_edges

    return upsert_edges(t.mentions, symmetric=True)


_EDGES = "SELECT LEAST(from_id, to_id) AS from_id, GREATEST(from_id, to_id) AS to_id, relation, COUNT(*) AS support, MAX(confidence) AS confidence FROM mentions GROUP BY 1, 2, 3"


def _graph_edges(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("d"))
    half = d.where("d >= 1").selectExpr("d AS source", "d div 2 AS target", "'child_of' AS relation")
    third = d.where("d >= 3").selectExpr("d AS source", "d div 3 AS target", "'related_to' AS relation")
    loop = t.spark.range(1).selectExpr("CAST(0 AS bigint) AS source", "CAST(7 AS bigint) AS target", "'loops' AS relation")
    return half.unionByName(third).unionByName(loop)


_GRAPH_EDGES = """SELECT doc_id AS source, doc_id // 2 AS target, 'child_of' AS relation FROM documents WHERE doc_id >= 1
  UNION ALL SELECT doc_id, doc_id // 3, 'related_to' FROM documents WHERE doc_id >= 3 UNION ALL SELECT 0, 7, 'loops'"""
_PROVENANCE = _case("doc_id % 5", ["user_confirmed", "imported", "observed", "generated", "inferred"])
_REVIEW = _case("doc_id % 4", ["confirmed", "evidence_only", "pending", "rejected"])
_LIFE = _case("doc_id % 6", ["active", "active", "stale", "superseded", "rejected", "disputed"])
_MEMORY = f"""doc_id AS memory_id, doc_id AS thought_id, concat('w', doc_id % 3) AS workspace_id, concat('p', doc_id % 4) AS project_id, {_PROVENANCE} AS provenance_status, {_REVIEW} AS review_status,
  {_LIFE} AS lifecycle_status, doc_id % 5 IN (0, 1) AS can_use_as_instruction, doc_id % 7 <> 0 AS can_use_as_evidence, doc_id % 2 = 0 AS requires_user_confirmation,
  CASE WHEN doc_id % 9 = 0 THEN 'personal' ELSE 'project' END AS visibility, {_TYPE} AS memory_type, CAST(doc_id % 11 AS double) / 10 AS confidence"""


_AGENT_MEMORIES = f"""SELECT m.*, created_at FROM (SELECT {_MEMORY} FROM labels) m JOIN (SELECT id, created_at FROM thoughts) t ON id = thought_id"""
_CONTACTS = "SELECT CAST(c_custkey AS BIGINT) AS contact_id, c_name AS name, c_mktsegment AS company, CAST(c_nationkey AS BIGINT) AS nation_id, c_acctbal AS balance FROM customer"
_INTERACTIONS = "SELECT CAST(o_orderkey AS BIGINT) AS interaction_id, CAST(o_custkey AS BIGINT) AS contact_id, CAST(o_orderdate AS DATE) AS occurred_on, o_orderpriority LIKE '1%' AS follow_up_needed, o_orderpriority AS kind, o_totalprice AS value, CASE o_orderstatus WHEN 'O' THEN 'proposal' WHEN 'F' THEN 'won' ELSE 'lost' END AS stage FROM orders"
_TASKS = "SELECT CAST(p_partkey AS BIGINT) AS task_id, p_name AS name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size * 7 AS INT) END AS frequency_days FROM part"
_LOGS = "SELECT CAST(l_partkey AS BIGINT) AS task_id, CAST(l_orderkey AS BIGINT) AS log_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_shipdate AS DATE) AS completed_on, l_extendedprice AS cost FROM lineitem"
_INGREDIENTS = "SELECT CAST(l_orderkey AS BIGINT) AS meal_id, CAST(l_linenumber AS BIGINT) AS place, p_name AS name, l_returnflag AS unit, CAST(CAST(l_quantity AS INT) AS {string}) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey"
_ANSWERS = "SELECT doc_id AS answer_id, doc_id % 20 AS lesson_id, doc_id % 7 AS quiz_id, quality = 1 AS is_correct, toxic = 1 AS flagged FROM labels"


def _sql_view(sql: str, *tables: str) -> Callable[[Tables], DataFrame]:
    """A view whose text is the same in both dialects."""

    def build(t: Tables) -> DataFrame:
        return t.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql), **{x: getattr(t, x) for x in tables})

    return build


VIEWS: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {
    "thoughts": (_thoughts, _THOUGHTS),
    "metadata_thoughts": (_metadata, _METADATA),
    "vector_thoughts": (_vectors, _VECTORS),
    "thought_entities": (_thought_entities, _THOUGHT_ENTITIES),
    "entities": (_entities, _ENTITIES),
    "mentions": (_mentions, _MENTIONS),
    "edges": (_edges, _EDGES),
    "graph_edges": (_graph_edges, _GRAPH_EDGES),
    "agent_memories": (_sql_view(_AGENT_MEMORIES, "labels", "thoughts"), _AGENT_MEMORIES),
    "contacts": (_sql_view(_CONTACTS, "customer"), _CONTACTS),
    "interactions": (_sql_view(_INTERACTIONS, "orders"), _INTERACTIONS),
    "tasks": (_sql_view(_TASKS, "part"), _TASKS),
    "task_logs": (_sql_view(_LOGS, "lineitem"), _LOGS),
    "ingredients": (_sql_view(_INGREDIENTS.format(string="STRING"), "lineitem", "part"), _INGREDIENTS.format(string="VARCHAR")),
    "answers": (_sql_view(_ANSWERS, "labels"), _ANSWERS),
}


def with_views(sql: str) -> str:
    """The SQL after definitions of the views that it names, and of those that these name."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name][1])
                need.append(name)

    add(sql)
    views = [f"{name} AS ({VIEWS[name][1]})" for name in need]
    body = sql.strip()
    if not views:
        return body
    if head := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {head[1] or ''}{', '.join(views)}, {body[head.end() :]}"
    return f"WITH {', '.join(views)} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers f(tables) by its name, with the SQL that has the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register

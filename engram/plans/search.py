"""Queries: vectors, text search, graph and provenance, streaming state, model steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import graph as G
from engram.operators import search as T
from engram.operators import vectors as V
from engram.operators.joins import neighbours
from engram.operators.upsert import upsert_edges
from engram.plans.functions import RECALL
from engram.plans.views import AS_OF, Tables, query

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_SIM = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))"
TIME = f"TIMESTAMP '{AS_OF}'"


def query_vector(t: Tables, vec_id: int = 0) -> list[float]:
    """The vector of one row, which is what a caller has at hand."""
    return list(t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


@query(f"SELECT id, type, ROUND(sim, 6) AS similarity FROM (SELECT id, type, {_SIM} AS sim FROM vector_thoughts WHERE list_contains(topics, 't0') OR id % 2 = 0) WHERE sim > 0.1 ORDER BY sim DESC, id LIMIT 10")
def v01_match_thoughts(t: Tables) -> DataFrame:
    hits = V.match_thoughts(t.vector_thoughts, query_vector(t), 0.1, 10, where=F.array_contains("topics", "t0") | (F.col("id") % 2 == 0))
    return hits.select("id", "type", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT id, ROUND(score, 6) AS score FROM (SELECT id, sim, sim * 0.7 + exp(-greatest(date_diff('second', created_at, {TIME}) / 86400.0, 0) / 90.0) * 0.3 AS score FROM (SELECT id, created_at, {_SIM} AS sim FROM vector_thoughts)) WHERE sim >= 0.05 ORDER BY score DESC, id LIMIT 20")
def v02_match_recent(t: Tables) -> DataFrame:
    return V.match_recent(t.vector_thoughts, query_vector(t), AS_OF, 0.05, 20, 0.3).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, ROUND({_SIM}, 6) AS similarity FROM embeddings WHERE {_SIM} > 0.2")
def v03_exact_index(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return rows.withColumn("similarity", V.similarity(F.col("embedding"), query_vector(t))).where("similarity > 0.2").select("id", F.round("similarity", 6).alias("similarity"))


_COS = "ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12)"


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS id, ROUND({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10""")
def v03_vector_index(t: Tables) -> DataFrame:
    """The index is built of two thirds of the vectors, the rest is appended; then every 50th vector asks for its ten nearest, exactly."""
    from engram.operators.cut import folder
    from engram.operators.vector_index import VectorIndex

    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(t.spark, folder(t.spark, "vectors"))
    index.build(rows.where("id % 3 <> 0"))
    index.append(rows.where("id % 3 = 0"))
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return index.search(queries, 10, exact=True, skip_self=True).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS id, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) = 1""")
def v04_duplicate_check(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest_pairs(queries, t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 0.3, 1).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT id, ROUND(sim, 6) AS similarity FROM (SELECT id, {_SIM} AS sim, sensitivity_tier FROM vector_thoughts) WHERE sim >= 0.05 AND sensitivity_tier IS DISTINCT FROM 'restricted' ORDER BY sim DESC, id LIMIT 15 OFFSET 15")
def v05_search_page(t: Tables) -> DataFrame:
    hits = V.match_thoughts(t.vector_thoughts, query_vector(t), 0.05, 30, where=~F.col("sensitivity_tier").eqNullSafe(F.lit("restricted")), inclusive=True)
    return hits.orderBy(F.desc("similarity"), "id").offset(15).limit(15).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT id, ROUND(sim, 6) AS similarity FROM (SELECT * FROM (SELECT id, {_SIM} AS sim FROM vector_thoughts) WHERE sim > 0.1 ORDER BY sim DESC, id LIMIT 30) WHERE id NOT IN (SELECT thought_id FROM thought_entities WHERE entity_id = 7)")
def v06_expand_entity(t: Tables) -> DataFrame:
    hits = V.match_thoughts(t.vector_thoughts, query_vector(t), 0.1, 30)
    linked = t.thought_entities.where("entity_id = 7").select(F.col("thought_id").alias("id"))
    return hits.join(linked, "id", "left_anti").select("id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dims, len(embedding) = 64 AS fits FROM embeddings")
def v07_dimensions(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.size("embedding").cast("bigint").alias("dims"), (F.size("embedding") == 64).alias("fits"))


@query(f"""WITH h AS (SELECT id AS hit, sim FROM (SELECT id, {_SIM} AS sim FROM vector_thoughts) WHERE sim > 0.05 ORDER BY sim DESC, id LIMIT 200), n AS (SELECT m.*, sim FROM agent_memories m JOIN h ON hit = thought_id WHERE workspace_id = 'w1' ORDER BY created_at DESC, memory_id DESC LIMIT 100)
SELECT memory_id, ROUND(CAST(sim + {RECALL} AS DOUBLE), 6) AS score FROM n WHERE lifecycle_status NOT IN ('stale', 'superseded', 'rejected', 'disputed') AND visibility <> 'personal' ORDER BY sim + {RECALL} DESC, memory_id LIMIT 50""")
def v08_recall(t: Tables) -> DataFrame:
    return V.recall(t.vector_thoughts, t.agent_memories, query_vector(t), "w1", items=50, threshold=0.05, include_unconfirmed=True).select("memory_id", F.round("score", 6).alias("score"))


@query()
def v09_embed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.hashed_embedding(F.col("text")).alias("embedding"))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS id, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) <= 5""")
def v10_batch_search(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest_pairs(queries, t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 0.2, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


_TOK = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"


def _search_sql(match: str, words: str, raw: str, limit: int, offset: int) -> str:
    return f"""WITH r AS (SELECT *, {_TOK} AS tok, ' ' || array_to_string({_TOK}, ' ') || ' ' AS joined FROM thoughts), m AS (SELECT *, {match} AS hit, contains(lower(content), '{raw}') AS lk FROM r), s AS (SELECT COUNT(*) FILTER (WHERE hit) AS hits, COUNT(*) FILTER (WHERE hit OR lk) AS al FROM m),
k AS (SELECT *, CAST(greatest(least(1.0, len(list_filter(tok, lambda x: x IN ({words}))) / 10), CASE WHEN lk THEN 0.35 ELSE 0.0 END) + coalesce(importance, 5) / 20 + coalesce(quality_score, 0.5) / 500 AS DOUBLE) AS rank FROM m, s WHERE hit OR (lk AND hits < {limit + offset}))
SELECT id, ROUND(rank, 6) AS rank, CASE WHEN hits < {limit + offset} THEN al ELSE hits END AS total_count FROM k ORDER BY k.rank DESC, created_at DESC, id DESC LIMIT {limit} OFFSET {offset}"""


@query(_search_sql("list_contains(tok, 'the') AND list_contains(tok, 'and') AND NOT list_contains(tok, 'shor')", "'the', 'and'", "the and -shor", 25, 5))
def t01_search_text(t: Tables) -> DataFrame:
    return T.search_text(t.thoughts, "the and -shor", 25, 5).select("id", F.round("rank", 6).alias("rank"), "total_count")


@query(_search_sql("contains(joined, ' of the ') OR (list_contains(tok, 'der') AND NOT list_contains(tok, 'und'))", "'of', 'the', 'der'", '"of the" or der -und', 50, 0))
def t02_web_query(t: Tables) -> DataFrame:
    return T.search_text(t.thoughts, '"of the" or der -und', 50).select("id", F.round("rank", 6).alias("rank"), "total_count")


@query(f"SELECT id, ROUND(least(1.0, len(list_filter({_TOK}, lambda x: x IN ('la', 'de'))) / 10), 6) AS rank FROM thoughts")
def t03_text_rank(t: Tables) -> DataFrame:
    return t.thoughts.select("id", F.round(T.text_rank("la de", F.col("content")), 6).alias("rank"))


def _covers_sql(first: str, second: str, rest: str) -> str:
    """Ranks by covers for two words that have to be there: id, rank, both."""
    return f"""WITH tok AS (SELECT id, {_TOK} AS tok FROM thoughts), w AS (SELECT id, unnest(tok) AS w, unnest(range(1, len(tok) + 1)) AS place FROM tok),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM w WHERE w IN ('{first}', '{second}')),
l AS (SELECT *, max(CASE WHEN w = '{first}' THEN n END) OVER p AS n1, max(CASE WHEN w = '{second}' THEN n END) OVER p AS n2, max(CASE WHEN w = '{first}' THEN place END) OVER p AS p1, max(CASE WHEN w = '{second}' THEN place END) OVER p AS p2 FROM e WINDOW p AS (PARTITION BY id ORDER BY place)),
c AS (SELECT *, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN least(n1, n2) END AS s, least(p1, p2) AS sp FROM l),
d AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY place) AS before FROM c), r AS (SELECT id, SUM(0.1::DOUBLE / (1 + (place - sp) - (n - s))) AS rank FROM d WHERE s IS NOT NULL AND s > coalesce(before, 0) GROUP BY id)
{rest}"""


@query(_covers_sql("la", "de", "SELECT id, ROUND(coalesce(rank, 0), 6) AS rank FROM thoughts LEFT JOIN r USING (id)"))
def t03_cover_rank(t: Tables) -> DataFrame:
    from engram.operators.text_index import cover_rank

    return t.thoughts.select("id", F.round(cover_rank("la de", F.col("content")), 6).alias("rank"))


@query(_covers_sql("the", "and", "SELECT id, ROUND(rank, 6) AS rank FROM r JOIN tok USING (id) WHERE NOT list_contains(tok, 'shor')"))
def t01_indexed_search(t: Tables) -> DataFrame:
    """The thoughts are indexed in two segments, a tenth is removed and put back, and a search reads its own words' postings."""
    from engram.operators.cut import folder
    from engram.operators.text_index import TextIndex

    index = TextIndex(t.spark, folder(t.spark, "texts"))
    index.add(t.thoughts.where("id % 3 <> 0"))
    index.add(t.thoughts.where("id % 3 = 0"))
    index.replace(t.thoughts.where("id % 10 = 0"))
    return index.search("the and -shor").select("id", F.round("rank", 6).alias("rank"))


_FIELDS = "regexp_extract_all(lower(concat_ws(' ', name, company, CAST(nation_id AS VARCHAR))), '[\\p{L}\\p{N}]+')"


@query(f"SELECT contact_id, ROUND(len(list_filter(f, lambda x: x IN ('machinery'))) / len(f), 6) AS score FROM (SELECT contact_id, {_FIELDS} AS f FROM contacts) WHERE list_contains(f, 'machinery') ORDER BY score DESC, contact_id LIMIT 40")
def t04_contacts_search(t: Tables) -> DataFrame:
    return T.search_fields(t.contacts, "machinery", ["name", "company", "nation_id"], "contact_id", 40).select("contact_id", F.round("score", 6).alias("score"))


#: What words of one stem look like, written out: the stems' rules aren't in SQL.
_MACHINES, _STREETS = "^machin(e|es|ed|ing)$", "^(furnitur|furniture|furnitures)$"


@query(f"""WITH w AS (SELECT contact_id, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS w, 1.0 AS weight FROM contacts UNION ALL SELECT contact_id, unnest(regexp_extract_all(lower(company), '[\\p{{L}}\\p{{N}}]+')), 0.4 FROM contacts),
s AS (SELECT contact_id, weight, CASE WHEN regexp_matches(w, '{_MACHINES}') THEN 'a' WHEN w = 'machinery' THEN 'b' WHEN regexp_matches(w, '{_STREETS}') THEN 'c' END AS s FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY contact_id, s ORDER BY weight DESC) AS k FROM s WHERE s IS NOT NULL), r AS (SELECT contact_id, SUM(weight / (k * k)) / (3 * pi() * pi() / 6) AS rank FROM n GROUP BY contact_id)
SELECT contact_id, ROUND(CAST(rank AS DOUBLE), 6) AS rank FROM r""")
def t04_stemmed_search(t: Tables) -> DataFrame:
    """All contacts that fit: machines, machinery (another stem) or furnitures."""
    from engram.operators.stemmed import search_stems

    out = search_stems(t.contacts, "machines or the machinery or furnitures", {"name": 1.0, "company": 0.4}, "contact_id", limit=2**31 - 1)
    return out.select("contact_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT token, COUNT(DISTINCT id) AS docs, COUNT(*) AS n FROM (SELECT id, unnest({_TOK}) AS token FROM thoughts) GROUP BY token")
def t05_inverted_index(t: Tables) -> DataFrame:
    return T.inverted_index(t.thoughts).groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@query("SELECT id FROM thoughts WHERE contains(lower(content), 'ment de')")
def t06_trigram_search(t: Tables) -> DataFrame:
    return T.trigram_search(t.thoughts.withColumn("trigrams", T.trigrams(F.col("content"))), "ment de").select("id")


@query("SELECT id FROM thoughts WHERE content ILIKE '%the%' OR source_type ILIKE '%src1%' ORDER BY created_at DESC, id DESC LIMIT 30")
def t07_like_fallback(t: Tables) -> DataFrame:
    from engram.operators.filters import any_like, newest

    return newest(t.thoughts.where(any_like(["content"], "the") | any_like(["source_type"], "src1")), 30).select("id")


@query("""WITH RECURSIVE walk AS (SELECT CAST(100 AS BIGINT) AS node, 0 AS depth, CAST(NULL AS VARCHAR) AS via, [CAST(100 AS BIGINT)] AS path UNION ALL
SELECT e.target, w.depth + 1, e.relation, list_append(w.path, e.target) FROM walk w JOIN graph_edges e ON e.source = w.node WHERE w.depth < 4 AND NOT list_contains(w.path, e.target))
SELECT node, CAST(depth AS BIGINT) AS depth, via, array_to_string(path, '>') AS path FROM walk""")
def g01_traverse(t: Tables) -> DataFrame:
    return G.traverse(t.graph_edges, 100, 4).select("node", "depth", "via", F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE adj AS (SELECT source AS a, target AS b, relation FROM graph_edges UNION SELECT target, source, relation FROM graph_edges),
walk AS (SELECT CAST(90 AS BIGINT) AS node, CAST([] AS STRUCT(p BIGINT, r VARCHAR)[]) AS back, [CAST(90 AS BIGINT)] AS path UNION ALL
SELECT b, list_prepend({'p': w.node, 'r': relation}, back), list_append(path, b) FROM walk w JOIN adj ON a = w.node WHERE len(path) <= 5 AND NOT list_contains(path, b)),
best AS (SELECT path, list_reverse(back) AS fwd FROM walk WHERE node = 70 ORDER BY len(path), back LIMIT 1)
SELECT CAST(i - 1 AS BIGINT) AS step, path[i] AS node, CASE WHEN i > 1 THEN fwd[i - 1].r END AS relation FROM best, (SELECT unnest(range(1, 8)) AS i) WHERE i <= len(path)""")
def g02_shortest_path(t: Tables) -> DataFrame:
    return G.shortest_path(t.graph_edges, 90, 70)


@query("SELECT target AS neighbour, relation, 'outgoing' AS direction FROM graph_edges WHERE source = 12 UNION ALL SELECT source, relation, 'incoming' FROM graph_edges WHERE target = 12")
def g03_neighbours(t: Tables) -> DataFrame:
    return neighbours(t.graph_edges, "source", "target").where("node = 12").select("neighbour", "relation", "direction")


@query("SELECT source, target, relation FROM graph_edges WHERE source NOT IN (SELECT entity_id FROM entities WHERE canonical_name ILIKE '%ring%') AND target NOT IN (SELECT entity_id FROM entities WHERE canonical_name ILIKE '%ring%')")
def g04_cascade_delete(t: Tables) -> DataFrame:
    gone = t.entities.where(F.col("canonical_name").ilike("%ring%")).select("entity_id")
    return t.graph_edges.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti").select("source", "target", "relation")


@query("""WITH RECURSIVE up AS (SELECT CAST(150 AS BIGINT) AS id, 0 AS depth, CAST(NULL AS BIGINT) AS parent, [CAST(150 AS BIGINT)] AS path, false AS cycle UNION ALL
SELECT p.source, u.depth + 1, u.id, list_append(u.path, p.source), list_contains(u.path, p.source) FROM up u JOIN (SELECT id, unnest(derived_from) AS source FROM thoughts) p ON p.id = u.id WHERE NOT u.cycle AND u.depth < 10)
SELECT up.id, CAST(depth AS BIGINT) AS depth, parent, cycle, coalesce(sensitivity_tier, '') = 'restricted' AS restricted FROM up JOIN thoughts t ON t.id = up.id""")
def g05_trace_provenance(t: Tables) -> DataFrame:
    return G.trace_provenance(t.thoughts, 150)


@query("""WITH RECURSIVE up AS (SELECT CAST(150 AS BIGINT) AS id, 0 AS depth, [CAST(150 AS BIGINT)] AS path, false AS cycle UNION ALL
SELECT p.source, u.depth + 1, list_append(u.path, p.source), list_contains(u.path, p.source) FROM up u JOIN (SELECT DISTINCT id, source FROM (SELECT id, unnest(derived_from) AS source FROM thoughts UNION ALL SELECT 12, 150)) p ON p.id = u.id WHERE NOT u.cycle AND u.depth < 10),
n AS (SELECT up.*, coalesce(sensitivity_tier, '') = 'restricted' AS restricted, content, row_number() OVER (ORDER BY depth, path) AS nth, COUNT(*) OVER () AS total FROM up JOIN thoughts t ON t.id = up.id), k AS (SELECT * FROM n WHERE nth <= 25)
SELECT array_to_string(path, '/') AS path, id, CAST(depth AS BIGINT) AS depth, CASE WHEN depth > 0 THEN array_to_string(path[:-2], '/') END AS under, cycle, restricted, CASE WHEN NOT restricted AND NOT cycle THEN substring(content, 1, 200) END AS preview, (SELECT COUNT(*) FROM k c WHERE c.depth = k.depth + 1 AND c.path[:-2] = k.path) AS parents, least(25, total) AS nodes, total > 25 AS truncated FROM k""")
def g06_provenance_tree(t: Tables) -> DataFrame:
    """With a thought derived from one that derives from it."""
    rows = t.thoughts.withColumn("derived_from", F.when(F.col("id") == 12, F.array_append("derived_from", F.lit(150).cast("long"))).otherwise(F.col("derived_from")))
    return G.provenance_tree(rows, 150, max_depth=10, cap=25)


@query("SELECT id FROM thoughts WHERE list_contains(derived_from, 10) AND sensitivity_tier <> 'restricted' ORDER BY created_at DESC, id DESC LIMIT 500")
def g07_derivatives(t: Tables) -> DataFrame:
    return G.derivatives(t.thoughts, 10).select("id")


_PARENTS = f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(body, ''), '{X.UUID}'), lambda x: lower(x))))"


@query(f"""WITH f AS (SELECT 'a' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || ' from 123E4567-e89b-12d3-a456-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') WHEN 1 THEN coalesce(text, '') || ' see #12' ELSE text END AS body FROM documents WHERE doc_id % 5 <> 1),
r AS (SELECT id, id % 7 = 0 AS bare, id % 6 = 0 AS known, body, path IS NULL AS missing, NOT (id % 6 = 0) AND regexp_matches(source_type, '[0-4]$') AS chosen FROM thoughts LEFT JOIN f ON id % 7 <> 0 AND path = 'a' || id),
p AS (SELECT *, regexp_matches(coalesce(body, ''), '#[0-9]{{1,18}}\\b') AS bad, {_PARENTS} AS found FROM r)
SELECT id, CASE WHEN known OR chosen THEN 'derived' ELSE 'primary' END AS layer, CASE WHEN chosen THEN 'synthesis' END AS method, CASE WHEN chosen AND NOT bad AND len(found) > 0 THEN array_to_string(found, ',') ELSE 'old' END AS parents,
CASE WHEN NOT chosen THEN NULL WHEN bare THEN 'no artifact path' WHEN missing THEN 'artifact not found' WHEN bad THEN 'parse error: references by number' WHEN len(found) > 0 THEN 'parsed ' || len(found) || ' parent ids' ELSE 'artifact has no parent ids' END AS reason FROM p""")
def g08_provenance_backfill(t: Tables) -> DataFrame:
    from engram.operators.provenance import provenance_backfill

    thoughts = t.thoughts.select("id", "source_type", F.when(F.col("id") % 6 == 0, "derived").otherwise("primary").alias("derivation_layer"), F.array(F.lit("old")).alias("derived_from"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("a"), "id")).alias("artifact_path"))
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit(" from 123E4567-e89b-12d3-a456-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))).when(F.col("doc_id") % 4 == 1, F.concat(text, F.lit(" see #12"))).otherwise(F.col("text"))
    artifacts = t.documents.where("doc_id % 5 <> 1").select(F.concat(F.lit("a"), "doc_id").alias("path"), body.alias("text"))
    done = provenance_backfill(thoughts, artifacts, ["0", "1", "2", "3", "4"])
    return done.select("id", F.col("derivation_layer").alias("layer"), F.col("derivation_method").alias("method"), F.array_join(F.array_sort("derived_from"), ",").alias("parents"), "reason")


@query("SELECT entity_id, canonical_name FROM entities WHERE canonical_name ILIKE '%red%' ORDER BY lower(canonical_name) = 'red widget' DESC, entity_id LIMIT 1")
def g09_entity_lookup(t: Tables) -> DataFrame:
    found = t.entities.where(F.col("canonical_name").ilike("%red%"))
    return found.orderBy(F.desc(X.entity_name(F.col("canonical_name")) == "red widget"), "entity_id").limit(1).select("entity_id", "canonical_name")


@query("SELECT id, type FROM thoughts JOIN thought_entities ON thought_id = id WHERE entity_id = 7 ORDER BY created_at DESC, id DESC LIMIT 200")
def g10_linked_thoughts(t: Tables) -> DataFrame:
    links = t.thought_entities.where("entity_id = 7").select(F.col("thought_id").alias("id"))
    return t.thoughts.join(links, "id").orderBy(F.desc("created_at"), F.desc("id")).limit(200).select("id", "type")


@query("""SELECT neighbour, relation, direction, support FROM (SELECT to_id AS neighbour, relation, 'outgoing' AS direction, support FROM edges WHERE from_id = 7 UNION ALL SELECT from_id, relation, 'incoming', support FROM edges WHERE to_id = 7) WHERE relation <> 'co_occurs_with' ORDER BY support DESC NULLS LAST, neighbour LIMIT 500""")
def g11_entity_edges(t: Tables) -> DataFrame:
    e = t.edges.where("relation <> 'co_occurs_with'")
    out = e.where("from_id = 7").select(F.col("to_id").alias("neighbour"), "relation", F.lit("outgoing").alias("direction"), "support")
    into = e.where("to_id = 7").select(F.col("from_id").alias("neighbour"), "relation", F.lit("incoming").alias("direction"), "support")
    return out.unionByName(into).orderBy(F.desc_nulls_last("support"), "neighbour").limit(500)


@query()
def g12_wiki_payload(t: Tables) -> DataFrame:
    links = t.thought_entities.groupBy("entity_id").agg(F.count("*").alias("thoughts"))
    ends = t.edges.select(F.explode(F.array("from_id", "to_id")).alias("entity_id"), "relation").groupBy("entity_id", "relation").agg(F.count("*").alias("n"))
    relations = ends.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("relation", "n"))).alias("relations"))
    return t.entities.join(links, "entity_id", "left").join(relations, "entity_id", "left").select("entity_id", "canonical_name", F.coalesce("thoughts", F.lit(0)).alias("thoughts"), F.to_json("relations").alias("relations"))


@query("""SELECT how, COUNT(*) AS n FROM (SELECT CASE WHEN contact_id % 2 = 0 THEN 'upgraded' WHEN contact_id % 4 = 1 THEN 'adopted' ELSE 'new' END AS how FROM contacts) GROUP BY how""")
def g13_resolve_people(t: Tables) -> DataFrame:
    from engram.operators.upsert import resolved_people

    c, mail = t.contacts, F.concat(F.lit("c"), "contact_id", F.lit("@x.org"))
    people = c.where("contact_id % 2 = 0").select(F.col("contact_id").alias("entity_id"), mail.alias("name"), mail.alias("email"))
    orphans = c.where("contact_id % 4 = 1").select(F.col("contact_id").alias("entity_id"), "name", F.lit(None).cast("string").alias("email"))
    return resolved_people(people.unionByName(orphans), c.select("name", mail.alias("email"))).groupBy("how").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN relation IN ('related_to', 'co_occurs_with') THEN least(from_id, to_id) ELSE from_id END AS from_id, CASE WHEN relation IN ('related_to', 'co_occurs_with') THEN greatest(from_id, to_id) ELSE to_id END AS to_id, relation, COUNT(*) AS support, ROUND(MAX(confidence), 2) AS confidence FROM mentions WHERE confidence >= 0.3 GROUP BY 1, 2, 3")
def g14_typed_edges(t: Tables) -> DataFrame:
    rows = upsert_edges(t.mentions.where("confidence >= 0.3"), relations=("related_to", "co_occurs_with"))
    return rows.withColumn("confidence", F.round("confidence", 2))


@query(f"SELECT id, ROUND(exp(-greatest(date_diff('second', created_at, {TIME}) / 86400.0, 0) / 30.0), 6) AS decay FROM thoughts WHERE created_at + INTERVAL 20 DAY > {TIME} - INTERVAL 30 DAY")
def g15_decay(t: Tables) -> DataFrame:
    from engram.functions.values import age_days

    end = F.col("created_at") + F.make_dt_interval(F.lit(20))
    return t.thoughts.where(end > F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(30))).select("id", F.round(F.exp(-age_days(F.col("created_at"), AS_OF) / 30), 6).alias("decay"))


@query("SELECT 'orphan_entity' AS problem, entity_id AS id FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM thought_entities) UNION ALL SELECT 'unlinked_thought', id FROM thoughts WHERE importance >= 60 AND id NOT IN (SELECT thought_id FROM thought_entities)")
def g16_graph_lint(t: Tables) -> DataFrame:
    links = t.thought_entities
    orphans = t.entities.join(links, "entity_id", "left_anti").select(F.lit("orphan_entity").alias("problem"), F.col("entity_id").alias("id"))
    loose = t.thoughts.where("importance >= 60").join(links.select(F.col("thought_id").alias("id")), "id", "left_anti").select(F.lit("unlinked_thought").alias("problem"), "id")
    return orphans.unionByName(loose)


@query("SELECT memory_id, idx FROM (SELECT memory_id, memory_id % 4 AS idx, row_number() OVER (PARTITION BY workspace_id, project_id, memory_id % 4 ORDER BY memory_id) AS n FROM agent_memories) WHERE n = 1")
def r03_idempotent_writeback(t: Tables) -> DataFrame:
    from engram.operators.upsert import latest

    return latest(t.agent_memories.withColumn("idx", F.col("memory_id") % 4), ["workspace_id", "project_id", "idx"], [F.col("memory_id")]).select("memory_id", "idx")


@query("SELECT event_id, user_id FROM (SELECT *, COUNT(*) FILTER (WHERE value < 5) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before < 2")
def r05_suppression(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.withColumn("before", F.coalesce(F.sum(F.when(F.col("value") < 5, 1).otherwise(0)).over(w), F.lit(0))).where("before < 2").select("event_id", "user_id")


#: Three events of a user within two days, one after the other.
LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, true AS ok, [moment] AS taken FROM e WHERE n = 1 UNION ALL
SELECT e.event_id, e.user_id, e.n, len(list_filter(taken, lambda x: x >= moment - 172800000000)) < 3, CASE WHEN len(list_filter(taken, lambda x: x >= moment - 172800000000)) < 3 THEN list_append(list_filter(taken, lambda x: x >= moment - 172800000000), moment) ELSE list_filter(taken, lambda x: x >= moment - 172800000000) END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, user_id, ok FROM w"""


@query(LIMITED)
def r08_rate_limit(t: Tables) -> DataFrame:
    """Three events of a user within two days; what is turned away doesn't count."""
    from engram.operators.windows import rate_limit

    return rate_limit(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", most=3, seconds=172800).select("event_id", "user_id", "ok")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 7 = 0")
def r09_incremental_sync(t: Tables) -> DataFrame:
    log = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit(5).alias("seen_at"))
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 9).otherwise(3).alias("updated_at")).join(log, "doc_id", "left")
    return rows.where("seen_at IS NULL OR updated_at > seen_at").select("doc_id")

"""Queries: write operators, each as the state that it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import values as V
from engram.operators import capture as C
from engram.operators import table as S
from engram.operators import upsert as K
from engram.operators.cut import folder
from engram.plans.views import AS_OF, Tables, query

_FP = "sha256(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))))"
#: Stored: every second document; incoming: all, in order of their numbers.
_UPSERT = f"""WITH r AS (SELECT 0 AS new, doc_id AS seq, text AS content, lang, source, CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, text, lang, NULL, CAST(doc_id AS VARCHAR) FROM documents),
f AS (SELECT *, {_FP.format('content')} AS fp FROM r)"""


def _writes(t: Tables) -> tuple[DataFrame, DataFrame]:
    meta = lambda *kv: F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull())
    d = t.documents
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), meta(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("ref"), F.col("doc_id").cast("string")).alias("metadata"))
    new = d.select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), meta(F.lit("lang"), F.col("lang"), F.lit("ref"), F.col("doc_id").cast("string")).alias("metadata"))
    return old, new


@query(f"{_UPSERT} SELECT fp AS fingerprint, first(content ORDER BY new, seq) AS content, last(lang ORDER BY new, seq) AS lang, last(ref ORDER BY new, seq) AS ref, last(source ORDER BY new, seq) FILTER (WHERE source IS NOT NULL) AS source, COUNT(*) AS writes FROM f GROUP BY fp")
def k01_upsert(t: Tables) -> DataFrame:
    merged = K.upsert_thoughts(*_writes(t))
    return merged.select("fingerprint", "content", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "ref", "source")], "writes")


_ENHANCED = f"""WITH o AS (SELECT {_FP.format('text')} AS fp, -1 AS seq, text AS content, 'journal' AS type_, 'old' AS source_, NULL AS web, lang, 10 AS importance, 20.0::DOUBLE AS quality, 'personal' AS tier, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'done' END AS status, TIMESTAMP '2023-01-01 00:00:00' AS moved_at, 'journal' AS meta
FROM documents WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1),
w AS (SELECT doc_id AS seq, '  ' || text AS content, CASE doc_id % 5 WHEN 0 THEN 'task' WHEN 1 THEN 'idea' WHEN 2 THEN '' WHEN 3 THEN 'lesson' END AS meta, CASE doc_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 8 ELSE 50 END AS importance, NULL AS web, 70.0::DOUBLE AS quality, CASE doc_id % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'new' WHEN 2 THEN '' END AS said FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id + 100000000, text, NULL, 50, 'web', 61.5, CASE WHEN doc_id % 3 = 0 THEN 'done' END FROM documents WHERE doc_id % 4 = 0),
n AS (SELECT {_FP.format('content')} AS fp, seq, content, coalesce(nullif(meta, ''), 'observation') AS type_, coalesce(web, 'unknown') AS source_, web, NULL AS lang, importance, quality, 'standard' AS tier,
  coalesce(nullif(said, ''), CASE WHEN meta IN ('task', 'idea') THEN 'new' END) AS status, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (seq % 1000000) SECOND AS moved_at, meta FROM w),
r AS (SELECT * FROM o UNION ALL BY NAME SELECT * FROM n), m AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY fp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT fp AS fingerprint, first(content ORDER BY seq) AS content, last(type_ ORDER BY seq) AS type, last(source_ ORDER BY seq) AS source_type, CAST(last(importance ORDER BY seq) AS BIGINT) AS importance, last(quality ORDER BY seq) AS quality_score, last(tier ORDER BY seq) AS sensitivity_tier,
  last(status ORDER BY seq) FILTER (WHERE status IS NOT NULL) AS status, last(moved_at ORDER BY seq) FILTER (WHERE seq < 0 OR status IS DISTINCT FROM before) AS status_updated_at, last(meta ORDER BY seq) FILTER (WHERE meta IS NOT NULL) AS meta_type, last(lang ORDER BY seq) FILTER (WHERE lang IS NOT NULL) AS lang, max(web) AS web FROM m GROUP BY fp"""


def _map(**pairs: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


@query(_ENHANCED)
def k02_enhanced_upsert(t: Tables) -> DataFrame:
    """Stored: a third of the documents; written: the half, then a quarter again."""
    old = K.latest(t.documents.where("doc_id % 3 = 0").withColumn("fingerprint", X.fingerprint(F.col("text"))), ["fingerprint"], [F.col("doc_id")])
    status = F.expr("CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'done' END")
    stored = old.select("fingerprint", F.col("text").alias("content"), _map(type=F.lit("journal"), lang=F.col("lang")).alias("metadata"), F.lit("journal").alias("type"), F.lit("old").alias("source_type"), F.lit(10).cast("long").alias("importance"), F.lit(20.0).alias("quality_score"), F.lit("personal").alias("sensitivity_tier"), status.alias("status"), F.lit("2023-01-01").cast("timestamp_ntz").alias("status_updated_at"))
    kind, weight = F.expr("CASE doc_id % 5 WHEN 0 THEN 'task' WHEN 1 THEN 'idea' WHEN 2 THEN '' WHEN 3 THEN 'lesson' END"), F.expr("CASE doc_id % 4 WHEN 0 THEN '120.4' WHEN 1 THEN '7.5' WHEN 2 THEN '-3' END")
    first = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("seq"), F.concat(F.lit("  "), "text").alias("content"), _map(type=kind, importance=weight).alias("metadata"), F.expr("CASE doc_id % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'new' WHEN 2 THEN '' END").alias("status"))
    second = t.documents.where("doc_id % 4 = 0").select((F.col("doc_id") + 100000000).alias("seq"), F.col("text").alias("content"), _map(source=F.lit("web"), quality_score=F.lit("61.5")).alias("metadata"), F.when(F.col("doc_id") % 3 == 0, "done").alias("status"))
    writes = first.unionByName(second).withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq % 1000000)"))
    keys = {"meta_type": "type", "lang": "lang", "web": "source"}
    return C.enhanced_upsert(stored, writes).select("*", *[F.try_element_at("metadata", F.lit(v)).alias(k) for k, v in keys.items()]).drop("metadata")


def _with_vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    old, new = _writes(t)
    v = t.embeddings.select(F.col("vec_id").alias("seq"), F.col("embedding")[0].cast("double").alias("embedding"))
    return old.join(v, "seq", "left"), new.join(v.withColumn("embedding", F.col("embedding") + 10), "seq", "left")


_VECTORS = f"""WITH r AS (SELECT 0 AS new, doc_id AS seq, text AS content, CAST(embedding[1] AS DOUBLE) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, text, CAST(embedding[1] AS DOUBLE) + 10 FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
f AS (SELECT *, {_FP.format('content')} AS fp FROM r)"""


@query(f"{_VECTORS} SELECT fp AS fingerprint, ROUND(last(e ORDER BY new, seq) FILTER (WHERE e IS NOT NULL), 6) AS e FROM f GROUP BY fp")
def k03_upsert_newest_vector(t: Tables) -> DataFrame:
    return K.upsert_thoughts(*_with_vectors(t), embedding="new").select("fingerprint", F.round("embedding", 6).alias("e"))


@query(f"{_VECTORS} SELECT fp AS fingerprint, ROUND(first(e ORDER BY new, seq) FILTER (WHERE e IS NOT NULL), 6) AS e FROM f GROUP BY fp")
def k04_upsert_first_vector(t: Tables) -> DataFrame:
    return K.upsert_thoughts(*_with_vectors(t), embedding="old").select("fingerprint", F.round("embedding", 6).alias("e"))


_DATED = "SELECT from_id, to_id, relation, 1 AS support, confidence, DATE '2024-01-01' + CAST(seen % 300 AS INT) AS valid_from, CASE WHEN seen % 5 = 0 THEN NULL ELSE DATE '2025-01-01' + CAST(seen % 300 AS INT) END AS valid_until FROM mentions"


@query(f"SELECT from_id, to_id, relation, CAST(SUM(support) AS BIGINT) AS support, MAX(confidence) AS confidence, MIN(valid_from) AS valid_from, CASE WHEN bool_or(valid_until IS NULL) THEN NULL ELSE MAX(valid_until) END AS valid_until FROM ({_DATED}) GROUP BY 1, 2, 3")
def k05_edges_upsert(t: Tables) -> DataFrame:
    day = "CAST(seen % 300 AS int)"
    rows = t.mentions.selectExpr("from_id", "to_id", "relation", "1 AS support", "confidence", f"date_add(DATE'2024-01-01', {day}) AS valid_from", f"IF(seen % 5 = 0, NULL, date_add(DATE'2025-01-01', {day})) AS valid_until")
    return K.merge_edges(rows)


@query("SELECT entity_type, lower(canonical_name) AS key, max_by(canonical_name, entity_id) AS name, MAX(entity_id) AS last_seen, COUNT(*) AS seen FROM entities GROUP BY 1, 2")
def k06_entity_upsert(t: Tables) -> DataFrame:
    return t.entities.groupBy("entity_type", X.entity_name(F.col("canonical_name")).alias("key")).agg(F.max_by("canonical_name", "entity_id").alias("name"), F.max("entity_id").alias("last_seen"), F.count("*").alias("seen"))


@query("""SELECT CASE WHEN relation IN ('related_to', 'co_occurs_with') THEN least(from_id, to_id) ELSE from_id END AS from_id, CASE WHEN relation IN ('related_to', 'co_occurs_with') THEN greatest(from_id, to_id) ELSE to_id END AS to_id, relation, COUNT(*) AS support, MAX(confidence) AS confidence FROM mentions GROUP BY 1, 2, 3""")
def k07_entity_edges(t: Tables) -> DataFrame:
    return K.upsert_edges(t.mentions, relations=K.SYMMETRIC)


@query("SELECT DISTINCT thought_id, entity_id FROM thought_entities UNION SELECT DISTINCT CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT) FROM orders")
def k08_links_upsert(t: Tables) -> DataFrame:
    new = t.orders.selectExpr("CAST(o_orderkey AS bigint) AS thought_id", "CAST(o_custkey AS bigint) AS entity_id")
    return K.insert_ignore(t.thought_entities, new, ["thought_id", "entity_id"])


@query("SELECT thought_id, entity_id FROM thought_entities WHERE thought_id NOT IN (SELECT CAST(o_orderkey AS BIGINT) FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT) FROM orders WHERE o_orderstatus = 'F'")
def k09_replace_links(t: Tables) -> DataFrame:
    new = t.orders.where("o_orderstatus = 'F'").selectExpr("CAST(o_orderkey AS bigint) AS thought_id", "CAST(o_custkey AS bigint) AS entity_id")
    return K.replace_all(t.thought_entities, new, "thought_id")


@query("""SELECT id, CASE WHEN id % 3 <> 0 THEN 'kept' WHEN id % 2 = 0 THEN 'stale' ELSE 'updated' END AS result, CASE WHEN id % 3 = 0 AND id % 2 <> 0 THEN 'edited' ELSE type END AS type, CASE WHEN id % 3 = 0 AND id % 2 <> 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS updated_at FROM thoughts""")
def k10_optimistic_update(t: Tables) -> DataFrame:
    old = t.thoughts.select("id", F.create_map(F.lit("type"), F.col("type")).alias("metadata"), F.col("created_at").alias("updated_at"))
    hour = F.expr("make_dt_interval(0, 1)")
    changes = t.thoughts.where("id % 3 = 0").select("id", F.create_map(F.lit("type"), F.lit("edited")).alias("new_metadata"), (F.col("created_at") + F.expr("make_dt_interval(1)")).alias("new_at"), F.when(F.col("id") % 2 == 0, F.col("created_at") - hour).otherwise(F.col("created_at") + hour).alias("if_unchanged_since"))
    return K.optimistic_update(old, changes).select("id", "result", F.try_element_at("metadata", F.lit("type")).alias("type"), "updated_at")


@query(f"""SELECT id, 'updated' AS result, 'v' || id % 3 AS mark, type AS meta_type_was, CASE WHEN id % 8 = 0 THEN 'lesson' ELSE type END AS meta_type, CASE WHEN id % 8 = 0 THEN 'lesson' ELSE type END AS type, CASE WHEN id % 12 = 0 THEN 9 ELSE importance END AS importance, CASE WHEN id % 16 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 16 = 0 THEN TIMESTAMP '{AS_OF}' ELSE created_at END AS status_updated_at FROM thoughts WHERE id % 4 = 0
UNION ALL SELECT id, 'kept', NULL, type, type, type, importance, status, created_at FROM thoughts WHERE id % 4 <> 0 UNION ALL SELECT -id - 1, 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM thoughts WHERE id % 20 = 0""")
def k11_rest_update(t: Tables) -> DataFrame:
    stored = t.thoughts.select("id", _map(type=F.col("type"), was=F.col("type")).alias("metadata"), "content", "type", "importance", "quality_score", "sensitivity_tier", "status", F.col("created_at").alias("status_updated_at"))
    every = lambda n, v: F.when(F.col("id") % n == 0, v)
    patches = t.thoughts.where("id % 4 = 0").select("id", _map(mark=F.concat(F.lit("v"), F.col("id") % 3)).alias("metadata"), F.lit(None).cast("string").alias("content"), every(8, "lesson").alias("type"), every(12, 9).cast("long").alias("importance"), F.lit(None).cast("long").alias("quality_score"), F.lit(None).cast("string").alias("sensitivity_tier"), every(16, "done").alias("status"), F.lit(AS_OF).cast("timestamp_ntz").alias("at"))
    stray = patches.where("id % 20 = 0").withColumn("id", -F.col("id") - 1)
    of = lambda k: F.try_element_at("metadata", F.lit(k))
    return C.patched(stored, patches.unionByName(stray)).select("id", "result", of("mark").alias("mark"), of("was").alias("meta_type_was"), of("type").alias("meta_type"), "type", "importance", "status", "status_updated_at")


@query("SELECT id, type FROM thoughts WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def k12_delete(t: Tables) -> DataFrame:
    return K.delete_ids(t.thoughts, t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))).select("id", "type")


@query("""SELECT id, 'updated' AS result, '{"by":"v' || id % 5 || '","kept":"k","score":"s"}' AS provenance, type FROM thoughts WHERE id % 2 = 0 UNION ALL SELECT id, 'kept', '{"by":"old","kept":"k"}', type FROM thoughts WHERE id % 2 <> 0 UNION ALL SELECT -id - 1, 'missing', NULL, NULL FROM thoughts WHERE id % 20 = 0""")
def k13_merge_provenance(t: Tables) -> DataFrame:
    stored = t.thoughts.select("id", _map(type=F.col("type"), provenance=F.lit('{"by":"old","kept":"k"}')).alias("metadata"))
    new = t.thoughts.where("id % 2 = 0").select("id", _map(by=F.concat(F.lit("v"), F.col("id") % 5), score=F.lit("s")).alias("new"))
    stray = new.where("id % 20 = 0").withColumn("id", -F.col("id") - 1)
    of = lambda k: F.try_element_at("metadata", F.lit(k))
    return C.merged_metadata(stored, new.unionByName(stray), under="provenance").select("id", "result", of("provenance").alias("provenance"), of("type").alias("type"))


@query("SELECT contact_id, last_contacted FROM contacts LEFT JOIN (SELECT contact_id AS c, max_by(occurred_on, interaction_id) AS last_contacted FROM interactions GROUP BY 1) ON c = contact_id")
def k14_last_contacted(t: Tables) -> DataFrame:
    last = t.interactions.groupBy("contact_id").agg(F.max_by("occurred_on", "interaction_id").alias("last_contacted"))
    return t.contacts.join(last, "contact_id", "left").select("contact_id", "last_contacted")


@query("SELECT task_id, last_completed, CASE WHEN frequency_days IS NOT NULL THEN last_completed + frequency_days END AS next_due FROM tasks LEFT JOIN (SELECT task_id AS k, MAX(completed_on) AS last_completed FROM task_logs GROUP BY 1) ON k = task_id")
def k15_next_due(t: Tables) -> DataFrame:
    last = t.task_logs.groupBy("task_id").agg(F.max("completed_on").alias("last_completed"))
    return t.tasks.join(last, "task_id", "left").select("task_id", "last_completed", F.date_add("last_completed", F.col("frequency_days")).alias("next_due"))


@query(f"""WITH n AS (SELECT doc_id AS id, {_FP.format('text')} AS fp, doc_id % 7 = 0 AS made FROM documents WHERE doc_id % 5 <> 0), q AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE {_FP.format('text')} END AS fp FROM documents WHERE doc_id % 4 <> 1),
j AS (SELECT coalesce(n.id, q.id) AS id, n.id IS NOT NULL AND NOT made AND n.fp IS DISTINCT FROM q.fp AS again, q.id IS NOT NULL AS stored, n.fp, q.fp AS was FROM n FULL JOIN q ON n.id = q.id)
SELECT id, CASE WHEN again THEN 'pending' ELSE 'complete' END AS status, CASE WHEN again THEN 0 ELSE 2 END AS attempts, CASE WHEN NOT again THEN 'e' END AS last_error, CASE WHEN again THEN fp ELSE was END AS fp, CASE WHEN again THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS queued_at FROM j WHERE again OR stored""")
def k16_enqueue_changed(t: Tables) -> DataFrame:
    fp = X.fingerprint(F.col("text"))
    new = t.documents.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), fp.alias("fp"), F.when(F.col("doc_id") % 7 == 0, "digest").alias("generated_by"), F.lit(AS_OF).cast("timestamp_ntz").alias("at"))
    queue = t.documents.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("id"), F.lit("complete").alias("status"), F.lit(2).alias("attempts"), F.lit("e").alias("last_error"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise(fp).alias("fp"), F.lit("2024-01-01").cast("timestamp_ntz").alias("queued_at"))
    return C.enqueued(queue, new)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_type = 'view' THEN 'complete' WHEN event_type = 'click' THEN 'pending' WHEN event_id % 6 + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status FROM events""")
def k17_queue_states(t: Tables) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "pending").otherwise("processing")
    outcome = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "click", "release").otherwise("error")
    return t.events.select("event_id", K.next_queue_state(status, outcome, F.col("event_id") % 6).alias("status"))


@query("SELECT id FROM thoughts WHERE id NOT IN (SELECT doc_id FROM labels) ORDER BY created_at DESC, id DESC LIMIT 100")
def k18_queue_backfill(t: Tables) -> DataFrame:
    return t.thoughts.join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_anti").orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id")


@query(f"SELECT doc_id AS id, CASE WHEN row_number() OVER (PARTITION BY {_FP.format('text')} ORDER BY doc_id) = 1 THEN {_FP.format('text')} END AS fingerprint FROM documents")
def k19_fingerprint_backfill(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.documents.select(F.col("doc_id").alias("id"), X.fingerprint(F.col("text")).alias("fp"))
    first = F.row_number().over(Window.partitionBy("fp").orderBy("id")) == 1
    return rows.select("id", F.when(first, F.col("fp")).alias("fingerprint"))


@query(f"""WITH f AS (SELECT doc_id AS id, {_FP.format('text')} AS fp FROM documents) SELECT id, CASE WHEN fp IN (SELECT fp FROM f WHERE id % 3 <> 0) THEN 'delete' ELSE 'patch' END AS action FROM f WHERE id % 3 = 0""")
def k20_null_fingerprints(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), X.fingerprint(F.col("text")).alias("fp"))
    known = rows.where("id % 3 <> 0").select("fp", F.lit("delete").alias("action")).distinct()
    return rows.where("id % 3 = 0").join(known, "fp", "left").select("id", F.coalesce("action", F.lit("patch")).alias("action"))


@query("SELECT contact_id, CAST(contact_id % 10 + COALESCE(n, 0) AS BIGINT) AS highlights, greatest(DATE '1999-01-01', latest) AS latest FROM contacts LEFT JOIN (SELECT contact_id AS c, COUNT(*) AS n, MAX(occurred_on) AS latest FROM interactions GROUP BY 1) ON c = contact_id")
def k21_highlight_counts(t: Tables) -> DataFrame:
    new = t.interactions.groupBy("contact_id").agg(F.count("*").alias("n"), F.max("occurred_on").alias("latest"))
    return t.contacts.join(new, "contact_id", "left").select("contact_id", (F.col("contact_id") % 10 + F.coalesce("n", F.lit(0))).alias("highlights"), F.greatest(F.to_date(F.lit("1999-01-01")), "latest").alias("latest"))


@query("SELECT contact_id, n_name AS owner FROM contacts JOIN nation ON n_nationkey = nation_id WHERE sha256(name) = sha256('Customer#000000011') AND balance > -100000")
def k22_key_lookup(t: Tables) -> DataFrame:
    wanted = F.sha2(F.lit("Customer#000000011"), 256)
    keys = t.contacts.where((F.sha2("name", 256) == wanted) & (F.col("balance") > -100000))
    return keys.join(t.nation, F.col("n_nationkey") == F.col("nation_id")).select("contact_id", F.col("n_name").alias("owner"))


_LAYER = f"(['{"', '".join(V.LAYERS)}'])[nth + 1]"


@query(f"""WITH s AS (SELECT event_id AS session_id, user_id, event_id % 4 + 1 AS version, CASE event_id % 7 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'review_ready' ELSE 'completed' END AS status, CASE WHEN event_id % 2 = 1 THEN 'friction' END AS layer, ts FROM events WHERE event_type = 'purchase'),
o AS (SELECT * FROM s WHERE status <> 'completed' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC) = 1),
c AS (SELECT session_id, user_id, version, (session_id + k) % 5 AS nth, 's' || session_id AS summary, CASE WHEN session_id % 3 <> 0 THEN ts END AS approved_at FROM s, (VALUES (0), (2)) v(k) WHERE session_id % 4 <> 3),
last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, nth ORDER BY version DESC, approved_at DESC NULLS LAST, session_id DESC) = 1),
a AS (SELECT session_id, string_agg({_LAYER} || '=' || summary, ',' ORDER BY nth) AS own FROM c GROUP BY 1), b AS (SELECT user_id, string_agg({_LAYER} || '=' || summary, ',' ORDER BY nth) AS latest FROM last GROUP BY 1)
SELECT u.user_id, CASE WHEN o.session_id IS NOT NULL AND u.user_id % 3 <> 0 THEN 'active' ELSE 'draft' END AS profile_status, CASE WHEN u.user_id % 3 <> 0 THEN u.user_id % 4 ELSE 0 END AS current_version, o.session_id, coalesce(o.status, 'in_progress') AS session_status,
coalesce(o.version, CASE WHEN u.user_id % 3 <> 0 THEN u.user_id % 4 ELSE 0 END + 1) AS session_version, CASE WHEN o.session_id IS NULL THEN '' ELSE 'operating_rhythms' END AS completed, CASE WHEN o.session_id IS NULL THEN 'operating_rhythms' ELSE coalesce(layer, 'recurring_decisions') END AS pending_layer,
coalesce(own, '') AS session_checkpoints, coalesce(latest, '') AS latest_checkpoints FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN o ON o.user_id = u.user_id LEFT JOIN a ON a.session_id = o.session_id LEFT JOIN b ON b.user_id = u.user_id""")
def k23_start_session(t: Tables) -> DataFrame:
    from engram.operators.sessions import start_sessions

    bought = t.events.where("event_type = 'purchase'")
    sessions = bought.selectExpr("event_id AS session_id", "user_id", "event_id % 4 + 1 AS version", "CASE event_id % 7 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'review_ready' ELSE 'completed' END AS status", "IF(event_id % 2 = 1, 'friction', NULL) AS current_layer", "array('operating_rhythms') AS completed_layers", "ts AS created_at")
    layers = F.array(*map(F.lit, V.LAYERS))
    at = lambda k: F.element_at(layers, ((F.col("event_id") + k) % 5 + 1).cast("int"))
    checkpoints = bought.select(F.col("event_id").alias("session_id"), "user_id", F.explode(F.array(at(0), at(2))).alias("layer"), (F.col("event_id") % 4 + 1).alias("version"), F.when(F.col("event_id") % 4 == 3, "draft").otherwise("approved").alias("status"), F.concat(F.lit("s"), "event_id").alias("summary"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("approved_at"))
    users = t.events.select("user_id").distinct()
    profiles = users.where("user_id % 3 <> 0").select("user_id", F.lit("active").alias("status"), (F.col("user_id") % 4).alias("current_version"))
    started = start_sessions(profiles, sessions, checkpoints, users)
    joined = lambda name: F.coalesce(F.array_join(F.transform(name, lambda x: F.concat_ws("=", x["layer"], x["summary"])), ","), F.lit("")).alias(name)
    return started.select("user_id", "profile_status", "current_version", "session_id", "session_status", "session_version", F.array_join("completed_layers", ",").alias("completed"), "pending_layer", joined("session_checkpoints"), joined("latest_checkpoints"))


@query("""WITH s AS (SELECT id, topics, CASE WHEN id % 11 = 0 THEN 'nonsense' WHEN id % 2 = 0 THEN 'operating_rhythms' ELSE 'friction' END AS layer FROM thoughts),
r AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'invalid layer' WHEN id % 5 = 0 THEN 'session is not editable' ELSE 'saved' END AS result FROM s),
e AS (SELECT id, 'friction' AS layer, 1 AS place, 'old' AS title FROM r WHERE result <> 'saved' OR layer <> 'friction' UNION ALL SELECT id, layer, unnest(range(1, 1 + len(topics))), unnest(topics) FROM r WHERE result = 'saved')
SELECT r.id AS session_id, result, CASE WHEN result <> 'saved' THEN 'dependencies' WHEN r.layer = 'friction' THEN 'dependencies,friction' ELSE 'operating_rhythms,dependencies' END AS completed,
CASE WHEN result = 'saved' AND r.layer <> 'friction' THEN 'recurring_decisions' ELSE 'operating_rhythms' END AS pending_layer, e.layer, CAST(place AS BIGINT) AS place, title FROM r LEFT JOIN e ON e.id = r.id""")
def k24_save_layer(t: Tables) -> DataFrame:
    """Each thought is a session with an old entry; every fifth is closed, and every eleventh save has no such layer."""
    from engram.operators.sessions import ENTRY, save_layers

    sessions = t.thoughts.select(F.col("id").alias("session_id"), F.when(F.col("id") % 5 == 0, "completed").otherwise("in_progress").alias("status"), F.array(F.lit("dependencies")).alias("completed_layers"))
    fields = [(x.split(" ")[0], x.split(" ")[1]) for x in ENTRY.split(", ")]
    old = t.thoughts.select(F.col("id").alias("session_id"), F.lit("friction").alias("layer"), F.lit(1).cast("long").alias("place"), *[F.lit("old" if n == "title" else None).cast(k).alias(n) for n, k in fields])
    layer = F.when(F.col("id") % 11 == 0, "nonsense").when(F.col("id") % 2 == 0, "operating_rhythms").otherwise("friction")
    payload = F.to_json(F.transform("topics", lambda x: F.struct(F.concat(F.lit(" "), x).alias("title"), F.lit("").alias("cadence"))))
    results, after, entries = save_layers(sessions, old, t.thoughts.select(F.col("id").alias("session_id"), layer.alias("layer"), payload.alias("payload"), F.lit(1).alias("seq")))
    rows = after.select("session_id", F.array_join("completed_layers", ",").alias("completed"), F.col("current_layer").alias("pending_layer"))
    return results.select("session_id", "result").join(rows, "session_id").join(entries.select("session_id", "layer", "place", "title"), "session_id", "left")


@query("SELECT id, array_to_string(list_transform(topics, lambda x: x || CASE WHEN x = 't1' THEN '=bought' ELSE '=open' END), ',') AS items FROM thoughts")
def k25_mark_item(t: Tables) -> DataFrame:
    items = F.transform("topics", lambda x: F.struct(x.alias("name"), F.lit("open").alias("state")))
    marked = F.transform(items, lambda i: i.withField("state", F.when(i["name"] == "t1", "bought").otherwise(i["state"])))
    return t.thoughts.select("id", F.array_join(F.transform(marked, lambda i: F.concat_ws("=", i["name"], i["state"])), ",").alias("items"))


@query("SELECT name, 'From job hunt: ' || n_name AS notes FROM contacts JOIN nation ON n_nationkey = nation_id WHERE company = 'BUILDING' AND contact_id NOT IN (SELECT contact_id FROM interactions WHERE occurred_on >= DATE '2000-06-01')")
def k26_copy_contacts(t: Tables) -> DataFrame:
    new = t.contacts.where("company = 'BUILDING'").join(t.interactions.where("occurred_on >= DATE'2000-06-01'").select("contact_id"), "contact_id", "left_anti")
    return new.join(t.nation, F.col("n_nationkey") == F.col("nation_id")).select("name", F.concat(F.lit("From job hunt: "), "n_name").alias("notes"))


@query("SELECT doc_id, CAST(i - 1 AS BIGINT) AS split_index, CAST(n AS BIGINT) AS split_total, part, lang FROM (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def k27_split_pack(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", "lang", F.size(X.lines(F.col("text"))).cast("bigint").alias("split_total"), F.posexplode(X.lines(F.col("text"))).alias("split_index", "part"))
    return parts.select("doc_id", F.col("split_index").cast("bigint").alias("split_index"), "split_total", "part", "lang")


_MAIL = r"""WITH m AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 4 <> 0 THEN '[Email from ' || doc_id || '] ' ELSE '' END || replace(text, '. ', '.' || chr(10)) AS content FROM documents),
p AS (SELECT id, lang, content, regexp_extract(content, '(?s)^(\[Email[^\]]*\])\s*(.*)$', 1) AS head, regexp_extract(content, '(?s)^(\[Email[^\]]*\])\s*(.*)$', 2) AS b FROM m),
a AS (SELECT *, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts, head <> '' AND len(list_filter(string_split_regex(b, '\s+'), lambda x: x <> '')) >= 40 AS long FROM p),
s AS (SELECT *, long AND len(parts) >= 2 AS gone FROM a), f AS (SELECT id, lang, head, len(parts) AS n, unnest(parts) AS atom, generate_subscripts(parts, 1) AS i FROM s WHERE gone)
SELECT 'thought' AS what, id AS a, CAST(NULL AS BIGINT) AS b, content AS text, lang AS kind FROM s WHERE NOT gone UNION ALL SELECT 'thought', id * 100000 + i - 1 + 1000000000, id, left(head, length(head) - 1) || ' | atom ' || i || ' of ' || n || '] ' || atom, lang FROM f
UNION ALL SELECT 'edge', CASE WHEN g.gone THEN g.id * 100000 + 1000000000 ELSE g.id END, CASE WHEN h.gone THEN h.id * 100000 + 1000000000 ELSE h.id END, NULL, relation FROM (SELECT source, target, CASE WHEN relation = 'child_of' THEN 'replies_to' ELSE relation END AS relation FROM graph_edges) e JOIN s g ON g.id = source JOIN s h ON h.id = target WHERE relation = 'replies_to' OR NOT (g.gone OR h.gone)
UNION ALL SELECT 'link', CASE WHEN f.id IS NULL THEN s.id ELSE f.id * 100000 + i - 1 + 1000000000 END, s.id % 50, NULL, NULL FROM s LEFT JOIN f ON f.id = s.id"""


@query(_MAIL)
def k28_reatomise(t: Tables) -> DataFrame:
    """Three of four documents as mails, a line an atom; the rows of all three results."""
    mails = t.documents.select(F.col("doc_id").alias("id"), "lang", F.concat(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("[Email from "), "doc_id", F.lit("] "))).otherwise(""), F.replace("text", F.lit(". "), F.lit(".\n"))).alias("content"))
    edges = t.graph_edges.join(mails.select(F.col("id").alias("source")), "source", "left_semi").join(mails.select(F.col("id").alias("target")), "target", "left_semi")
    edges = edges.select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.when(F.col("relation") == "child_of", "replies_to").otherwise(F.col("relation")).alias("relation"))
    links = mails.select(F.col("id").alias("thought_id"), (F.col("id") % 50).alias("entity_id"))
    after, turned, relinked = C.reatomised(mails, edges, links, X.lines(F.col("body")), F.col("id") * 100000 + F.col("place") + 1000000000, 40)
    rows = after.select(F.lit("thought").alias("what"), F.col("id").alias("a"), F.col("re_atomized_from").alias("b"), F.col("content").alias("text"), F.col("lang").alias("kind"))
    rows = rows.unionByName(turned.select(F.lit("edge").alias("what"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(None).cast("string").alias("text"), F.col("relation").alias("kind")))
    return rows.unionByName(relinked.select(F.lit("link").alias("what"), F.col("thought_id").alias("a"), F.col("entity_id").alias("b"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("kind")))


@query()
def k29_json_backup(t: Tables) -> DataFrame:
    from engram.sources.exports import backup

    return backup({"thoughts": t.metadata_thoughts, "edges": t.edges, "memories": t.agent_memories})


@query()
def k30_markdown_digest(t: Tables) -> DataFrame:
    from engram.sources.exports import digest_lines

    return digest_lines(t.thoughts, AS_OF, 90)


@query("SELECT event_type AS action, COUNT(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT 'audit' FROM documents WHERE doc_id % 10 = 0) GROUP BY 1")
def k31_append_audit(t: Tables) -> DataFrame:
    new = t.documents.where("doc_id % 10 = 0").select(F.lit("audit").alias("action"))
    return t.events.select(F.col("event_type").alias("action")).unionByName(new).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id >= 3 THEN id // 2 END AS supersedes FROM thoughts WHERE CASE WHEN id >= 3 THEN id // 2 END IS DISTINCT FROM CASE WHEN id % 5 <> 0 AND id >= 3 THEN id // 2 END")
def k33_mirror_repair(t: Tables) -> DataFrame:
    truth = F.try_element_at("derived_from", F.lit(1))
    mirror = F.when(F.col("id") % 5 != 0, truth)
    return t.thoughts.where(~truth.eqNullSafe(mirror)).select("id", truth.alias("supersedes"))


_LESSONS = "SELECT 's' || doc_id AS slug, 'p' || doc_id AS path, sha256(text) AS digest FROM documents WHERE doc_id % 5 <> 0"
_SEEN = "SELECT CASE WHEN doc_id % 7 = 0 THEN 'renamed' || doc_id ELSE 's' || doc_id END AS slug, 'p' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'edited' ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 4 <> 0"


@query(f"""WITH o AS ({_LESSONS}), n AS ({_SEEN}), m AS (SELECT n.slug, n.digest, o.slug AS old, o.digest AS was FROM n LEFT JOIN o ON o.slug = n.slug OR (o.path = n.path AND NOT EXISTS (SELECT 1 FROM o p WHERE p.slug = n.slug)))
SELECT slug, CASE WHEN old IS NULL THEN 'insert' WHEN was = digest THEN 'keep' ELSE 'update' END AS action FROM m UNION ALL SELECT slug, 'delete' FROM o WHERE slug NOT IN (SELECT old FROM m WHERE old IS NOT NULL)""")
def k34_content_sync(t: Tables) -> DataFrame:
    stored = t.documents.where("doc_id % 5 <> 0").selectExpr("concat('s', doc_id) AS slug", "concat('p', doc_id) AS path", "sha2(text, 256) AS digest")
    seen = t.documents.where("doc_id % 4 <> 0").selectExpr("IF(doc_id % 7 = 0, concat('renamed', doc_id), concat('s', doc_id)) AS slug", "concat('p', doc_id) AS path", "IF(doc_id % 3 = 0, 'edited', sha2(text, 256)) AS digest")
    return K.sync_plan(stored, seen, "slug", "path", "digest")


@query("""WITH p AS (SELECT contact_id AS id, name AS given, 'c' || contact_id || '@x.org' AS mail FROM contacts)
SELECT id AS entity_id, CASE WHEN id % 4 = 0 AND id % 3 <> 1 THEN mail ELSE given END AS name, CASE WHEN id % 2 = 0 THEN mail END AS email, CASE WHEN id % 12 = 4 THEN 'upgraded' ELSE 'kept' END AS how FROM p WHERE id % 3 = 0 OR (id % 3 = 1 AND id % 2 = 0)
UNION ALL SELECT CASE WHEN id % 3 = 1 THEN id END, given, mail, CASE WHEN id % 3 = 1 THEN 'adopted' ELSE 'new' END FROM p WHERE id % 3 = 2 OR (id % 3 = 1 AND id % 2 = 1)""")
def k35_correspondents(t: Tables) -> DataFrame:
    """Of three contacts one is known, one is seen, and one is both."""
    mail = F.concat(F.lit("c"), "contact_id", F.lit("@x.org"))
    people = t.contacts.where("contact_id % 3 <> 2").select(F.col("contact_id").alias("entity_id"), F.when(F.col("contact_id") % 4 == 0, mail).otherwise(F.col("name")).alias("name"), F.when(F.col("contact_id") % 2 == 0, mail).alias("email"))
    seen = t.contacts.where("contact_id % 3 <> 0").select(F.col("name"), F.upper(mail).alias("email"))
    return K.resolved_people(people, seen)


@query("SELECT id, CASE WHEN k = 1 THEN 'decision' ELSE 'work_log' END AS memory_type, CAST(i - 1 AS BIGINT) AS place, CASE WHEN k = 2 THEN 'Next step: ' ELSE '' END || v AS content FROM (SELECT id, 1 AS k, unnest(topics) AS v, generate_subscripts(topics, 1) AS i FROM thoughts UNION ALL SELECT id, 2, unnest(people), generate_subscripts(people, 1) FROM thoughts)")
def k36_payload_rows(t: Tables) -> DataFrame:
    return K.payload_rows(t.thoughts, {"topics": "decision", "people": "work_log"}, prefixed={"people": "Next step: "})


@query(f"""WITH r AS (SELECT 0 AS new, doc_id AS seq, text AS content, lang, source, CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END, doc_id, text, lang, NULL, CAST(doc_id AS VARCHAR) FROM documents),
f AS (SELECT *, {_FP.format('content')} AS fp FROM r)
SELECT fp AS fingerprint, first(content ORDER BY new, seq) AS content, last(lang ORDER BY new, seq) AS lang, last(ref ORDER BY new, seq) AS ref, last(source ORDER BY new, seq) FILTER (WHERE source IS NOT NULL) AS source, COUNT(*) AS writes FROM f GROUP BY fp""")
def k01_stored_upsert(t: Tables) -> DataFrame:
    """Three batches into a stored table, the second of them twice, and the table read back."""
    table = S.KeyedTable(t.spark, folder(t.spark, "thoughts"), S.THOUGHTS, ["fingerprint"], 16)
    old, new = _writes(t)
    for number, rows in enumerate((old, new.where("seq % 3 = 0"), new.where("seq % 3 = 0"), new.where("seq % 3 <> 0"))):
        S.store_thoughts(table, rows, ("import", max(number - 1, 0) if number > 1 else number))
    return table.read().select("fingerprint", "content", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "ref", "source")], "writes")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id + 1000000000, lang, 0 FROM documents WHERE doc_id % 7 = 0""")
def k12_stored_rows(t: Tables) -> DataFrame:
    """Documents are stored; a third is replaced, some are new, some of what is there is offered again and passed over, a fifth is deleted."""
    table = S.KeyedTable(t.spark, folder(t.spark, "rows"), "id bigint, lang string, n_chars bigint", ["id"], 16)
    rows = t.documents.select(F.col("doc_id").alias("id"), "lang", "n_chars")
    S.store_rows(table, rows)
    S.store_rows(table, rows.where("id % 3 = 0").withColumn("lang", F.upper("lang")))
    S.store_rows(table, rows.where("id % 7 = 0").selectExpr("id + 1000000000 AS id", "lang", "0L AS n_chars").unionByName(rows.withColumn("lang", F.lit("no"))), replace=False)
    S.remove_rows(table, rows.where("id % 5 = 0"))
    return table.read()


@query("SELECT least(a, b) AS from_id, greatest(a, b) AS to_id, 'writes_to' AS relation, 2 * COUNT(*) AS support, MAX(w) AS confidence FROM (SELECT l_partkey AS a, l_suppkey AS b, l_discount::DOUBLE AS w FROM lineitem) GROUP BY 1, 2")
def k05_stored_edges(t: Tables) -> DataFrame:
    """Mentions in two halves, each also the other way round, summed into a stored table."""
    table = S.KeyedTable(t.spark, folder(t.spark, "edges"), S.EDGES, ["from_id", "to_id", "relation"], 16)
    mentions = t.lineitem.select("l_linenumber", F.col("l_partkey").cast("long").alias("from_id"), F.col("l_suppkey").cast("long").alias("to_id"), F.lit("writes_to").alias("relation"), F.col("l_discount").cast("double").alias("confidence"))
    for number, half in enumerate((mentions.where("l_linenumber % 2 = 0"), mentions.where("l_linenumber % 2 = 1"))):
        S.store_edges(table, half.drop("l_linenumber").unionByName(half.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation", "confidence")), True, ("mentions", number))
    return table.read()


@query("""WITH q AS (SELECT doc_id AS id, n_chars AS queued_at, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents)
SELECT id, queued_at, CASE WHEN n <= 100 AND n % 2 = 0 THEN 'complete' WHEN n <= 60 THEN 'pending' WHEN n <= 100 THEN 'processing' WHEN n <= 150 THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN n <= 60 AND n % 2 = 1 THEN 1 ELSE 0 END AS attempts, CASE WHEN n <= 60 AND n % 2 = 1 THEN 'no answer' END AS last_error, CASE WHEN n <= 60 AND n % 2 = 1 THEN NULL WHEN n <= 150 THEN 'second' END AS worker,
  CASE WHEN n <= 100 AND n % 2 = 0 OR n <= 60 THEN NULL WHEN n <= 150 THEN 300::BIGINT END AS lease_until FROM q""")
def r01_claims(t: Tables) -> DataFrame:
    """One worker claims a hundred items and dies; another claims them and fifty more when the lease has run out, and settles some of them."""
    from pyspark.sql import Window

    queue = S.WorkQueue(t.spark, folder(t.spark, "claims"))
    items = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("queued_at"))
    queue.put(items)
    queue.claim("first", 100, now=0, lease=100)
    mine = t.spark.createDataFrame([(k, n) for n, k in enumerate(queue.claim("second", 150, now=200, lease=100), 1)], "id bigint, n int")
    known = items.join(F.broadcast(mine.select("id")), "id").withColumn("n", F.row_number().over(Window.orderBy("queued_at", "id")))
    queue.settle("first", known.select("id", F.lit("complete").alias("outcome"), F.lit(None).cast("string").alias("error")), now=201)
    done = known.where("n <= 100 AND n % 2 = 0").select("id", F.lit("complete").alias("outcome"), F.lit(None).cast("string").alias("error"))
    queue.settle("second", done.unionByName(known.where("n <= 60 AND n % 2 = 1").select("id", F.lit("error").alias("outcome"), F.lit("no answer").alias("error"))), now=202)
    return queue.read()

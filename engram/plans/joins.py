"""Queries: joins, set operations, windows, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import joins as N
from engram.operators.similar import near_duplicates
from engram.operators.upsert import latest
from engram.plans.views import Tables, query


@query("SELECT a.canonical_name AS from_name, b.canonical_name AS to_name, relation, support FROM edges JOIN entities a ON a.entity_id = from_id JOIN entities b ON b.entity_id = to_id")
def n01_edge_names(t: Tables) -> DataFrame:
    return N.with_names(t.edges, t.entities).select("from_name", "to_name", "relation", "support")


@query("SELECT log_id, line, name, frequency_days FROM task_logs LEFT JOIN tasks USING (task_id)")
def n02_left_embed(t: Tables) -> DataFrame:
    return t.task_logs.join(t.tasks, "task_id", "left").select("log_id", "line", "name", "frequency_days")


@query("""SELECT CAST(l_orderkey AS BIGINT) AS application_id, CAST(l_linenumber AS BIGINT) AS interview, c_name AS posting, n_name AS company
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_shipdate >= TIMESTAMP '2000-01-01'""")
def n03_inner_chain(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_shipdate >= timestamp_ntz'2000-01-01'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(F.col("l_orderkey").cast("bigint").alias("application_id"), F.col("l_linenumber").cast("bigint").alias("interview"), F.col("c_name").alias("posting"), F.col("n_name").alias("company"))


@query("""SELECT contact_id, name, CAST(COALESCE(n, 0) AS BIGINT) AS interactions, COALESCE(kinds, '') AS kinds FROM contacts LEFT JOIN
(SELECT contact_id, COUNT(*) AS n, string_agg(kind, ',' ORDER BY occurred_on DESC, interaction_id) AS kinds FROM interactions GROUP BY contact_id) USING (contact_id)""")
def n04_contact_history(t: Tables) -> DataFrame:
    entry = F.struct((-F.unix_date("occurred_on")).alias("day"), "interaction_id", "kind")
    history = t.interactions.groupBy("contact_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("all"))
    return t.contacts.join(history, "contact_id", "left").select("contact_id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("interactions"), F.coalesce(F.array_join("all.kind", ","), F.lit("")).alias("kinds"))


@query("SELECT id FROM thoughts WHERE importance >= 60 AND id NOT IN (SELECT thought_id FROM thought_entities)")
def n05_unlinked_important(t: Tables) -> DataFrame:
    return t.thoughts.where("importance >= 60").join(t.thought_entities.select(F.col("thought_id").alias("id")), "id", "left_anti").select("id")


@query("SELECT entity_id, entity_type FROM entities WHERE entity_id NOT IN (SELECT from_id FROM edges WHERE support >= 5 UNION SELECT to_id FROM edges WHERE support >= 5)")
def n06_entities_without_edges(t: Tables) -> DataFrame:
    ends = t.edges.where("support >= 5").select(F.explode(F.array("from_id", "to_id")).alias("entity_id"))
    return t.entities.join(ends, "entity_id", "left_anti").select("entity_id", "entity_type")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def n07_not_in(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("doc_id IS NOT NULL"), "doc_id", "left_anti").select("doc_id")


@query("SELECT id FROM thoughts WHERE id <> 9 AND (list_has_any(topics, (SELECT topics FROM thoughts WHERE id = 9)) OR list_has_any(people, (SELECT people FROM thoughts WHERE id = 9)))")
def n08_shared_exists(t: Tables) -> DataFrame:
    pick = lambda c: t.thoughts.select("id", F.explode(c).alias("value"), F.lit(c).alias("kind"))
    values = pick("topics").unionByName(pick("people"))
    mine = values.where("id = 9").select("value", "kind")
    return values.where("id <> 9").join(mine, ["value", "kind"], "left_semi").select("id").distinct()


@query("SELECT contact_id, name FROM contacts WHERE nation_id IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA') OR company = 'BUILDING'")
def n09_semi_or(t: Tables) -> DataFrame:
    inside = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi").select(F.col("n_nationkey").cast("bigint").alias("nation_id"), F.lit(True).alias("inside"))
    return t.contacts.join(inside, "nation_id", "left").where("inside OR company = 'BUILDING'").select("contact_id", "name")


@query("SELECT topic, COUNT(*) AS thoughts FROM (SELECT unnest(topics) AS topic FROM thoughts) GROUP BY topic")
def n10_lateral_unnest(t: Tables) -> DataFrame:
    return t.thoughts.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("thoughts"))


@query("SELECT type, ROUND(COUNT(*) / (SELECT COUNT(*) FROM thoughts), 6) AS share FROM thoughts GROUP BY type")
def n11_with_total(t: Tables) -> DataFrame:
    counts = t.thoughts.groupBy("type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("type", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_TOKENS = "list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{3,}'))"


@query(f"""WITH sets AS (SELECT id, {_TOKENS} AS s FROM thoughts), filled AS (SELECT * FROM sets WHERE len(s) > 0),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS similarity FROM filled a JOIN filled b ON a.id < b.id
WHERE least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s)) AND len(list_intersect(a.s, b.s)) >= 0.85 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
ends AS (SELECT id_a AS id, id_b AS other, similarity FROM pairs UNION ALL SELECT id_b, id_a, similarity FROM pairs),
counted AS (SELECT id, COUNT(*) AS n, MAX(similarity) AS best, MIN(CASE WHEN similarity = 1 THEN other END) AS same, COUNT(CASE WHEN similarity = 1 THEN 1 END) AS copies FROM ends GROUP BY 1)
SELECT sets.id, coalesce(least(sets.id, same), sets.id) AS class_id, 1 + coalesce(copies, 0) AS copies, coalesce(n, 0) AS n_links, ROUND(best, 6) AS best FROM sets LEFT JOIN counted ON counted.id = sets.id""")
def n12_near_duplicates(t: Tables) -> DataFrame:
    return near_duplicates(t.thoughts).withColumn("best", F.round("best", 6))


@query("SELECT x.thought_id AS a, y.thought_id AS b, COUNT(*) AS shared FROM thought_entities x JOIN thought_entities y ON x.entity_id = y.entity_id AND x.thought_id < y.thought_id GROUP BY 1, 2 HAVING COUNT(*) >= 2")
def n13_shared_entities(t: Tables) -> DataFrame:
    return N.shared_pairs(t.thought_entities, 2, "thought_id", "entity_id")


@query("""WITH a AS (SELECT topics AS ta, people AS pa FROM thoughts WHERE id = 9) SELECT id, array_to_string(list_filter(topics, lambda x: list_contains(ta, x)), ',') AS shared_topics, array_to_string(list_filter(people, lambda x: list_contains(pa, x)), ',') AS shared_people,
CAST(len(list_filter(topics, lambda x: list_contains(ta, x))) + len(list_filter(people, lambda x: list_contains(pa, x))) AS BIGINT) AS overlap FROM thoughts, a WHERE id <> 9 AND sensitivity_tier <> 'restricted'
AND (list_has_any(topics, ta) OR list_has_any(people, pa)) ORDER BY overlap DESC, id LIMIT 40""")
def n14_connections(t: Tables) -> DataFrame:
    return N.connections(t.thoughts, 9).orderBy(F.desc("overlap"), "id").limit(40).select("id", F.array_join("shared_topics", ",").alias("shared_topics"), F.array_join("shared_people", ",").alias("shared_people"), "overlap")


@query("""SELECT from_id, to_id FROM (SELECT DISTINCT from_id, to_id FROM mentions WHERE relation = 'uses') u WHERE EXISTS (SELECT 1 FROM mentions m WHERE m.relation <> 'related_to' AND m.relation <> 'uses' AND ((m.from_id = u.from_id AND m.to_id = u.to_id) OR (m.from_id = u.to_id AND m.to_id = u.from_id)))""")
def n15_pair_exists(t: Tables) -> DataFrame:
    m = t.mentions
    key = N.pair_key(F.col("from_id"), F.col("to_id")).alias("pair")
    others = m.where("relation NOT IN ('related_to', 'uses')").select(key).distinct()
    return m.where("relation = 'uses'").select("from_id", "to_id").distinct().withColumn("pair", key).join(others, "pair", "left_semi").select("from_id", "to_id")


@query("SELECT id, status FROM thoughts LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'done' ELSE 'new' END AS mirror FROM labels) ON doc_id = id WHERE status IS DISTINCT FROM mirror")
def n16_drift(t: Tables) -> DataFrame:
    mirror = t.labels.selectExpr("doc_id AS id", "IF(quality = 1, 'done', 'new') AS mirror")
    return t.thoughts.join(mirror, "id", "left").where(~F.col("status").eqNullSafe(F.col("mirror"))).select("id", "status")


@query("SELECT id, CASE WHEN doc_id IS NOT NULL THEN concat('label-', quality) ELSE status END AS status FROM thoughts LEFT JOIN labels ON doc_id = id")
def n17_update_from(t: Tables) -> DataFrame:
    new = t.labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("label-"), "quality").alias("new"))
    return t.thoughts.join(new, "id", "left").select("id", F.coalesce("new", "status").alias("status"))


@query("SELECT vec_id AS id, rank, type FROM (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) h JOIN thoughts ON id = vec_id WHERE rank <= 20")
def n18_hits_with_rows(t: Tables) -> DataFrame:
    hits = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("score")).orderBy(F.desc("score"), "id").limit(20)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint"))
    return ranked.join(t.thoughts, "id").orderBy("rank").select("id", "rank", "type")


@query("SELECT source AS node, target AS neighbour, relation, 'outgoing' AS direction FROM graph_edges UNION ALL SELECT target, source, relation, 'incoming' FROM graph_edges")
def n19_adjacency(t: Tables) -> DataFrame:
    return N.neighbours(t.graph_edges, "source", "target")


@query("""WITH n AS (SELECT DISTINCT lower(name) AS name FROM tasks UNION SELECT 'unknown thing' UNION SELECT 'small'), e AS (SELECT entity_id, lower(canonical_name) AS k FROM entities),
m AS (SELECT name, entity_id, CASE WHEN name = k THEN 1 WHEN split_part(name, ' ', 1) = split_part(k, ' ', 1) AND length(split_part(k, ' ', 1)) >= 3 THEN 2 WHEN contains(name, k) OR contains(k, name) THEN 3 END AS rank FROM n, e),
b AS (SELECT name, MIN(rank * 100000 + entity_id) AS v FROM m WHERE rank IS NOT NULL GROUP BY name)
SELECT n.name, CAST(v % 100000 AS BIGINT) AS entity_id, CASE v // 100000 WHEN 1 THEN 'equal' WHEN 2 THEN 'first_word' WHEN 3 THEN 'contained' ELSE 'new' END AS how FROM n LEFT JOIN b USING (name)""")
def n20_fuzzy_names(t: Tables) -> DataFrame:
    names = t.tasks.select(F.lower("name").alias("name")).unionByName(t.spark.createDataFrame([("unknown thing",), ("small",)], "name string"))
    return N.fuzzy_names(names, t.entities)


@query("SELECT vec_id AS id FROM embeddings WHERE embedding[1] > 0.1 AND vec_id NOT IN (SELECT thought_id FROM thought_entities JOIN entities USING (entity_id) WHERE entity_type = 'person')")
def n21_semantic_minus_linked(t: Tables) -> DataFrame:
    linked = t.thought_entities.join(t.entities.where("entity_type = 'person'"), "entity_id", "left_semi").select(F.col("thought_id").alias("id"))
    return t.embeddings.where(F.col("embedding")[0] > 0.1).select(F.col("vec_id").alias("id")).join(linked, "id", "left_anti")


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1 AND d.role = 'user')")
def n22_missing_reply(t: Tables) -> DataFrame:
    replies = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.conversations.where("role = 'assistant'").join(replies, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("SELECT id FROM thoughts WHERE contains(content, 'the') UNION SELECT id FROM thoughts WHERE contains(content, 'un')")
def u01_union_distinct(t: Tables) -> DataFrame:
    hits = lambda x: t.thoughts.where(F.contains("content", F.lit(x))).select("id")
    return hits("the").unionByName(hits("un")).distinct()


@query("SELECT source, target FROM graph_edges WHERE relation = 'child_of' UNION ALL SELECT target, source FROM graph_edges WHERE relation <> 'child_of'")
def u02_union_all(t: Tables) -> DataFrame:
    g = t.graph_edges
    return g.where("relation = 'child_of'").select("source", "target").unionByName(g.where("relation <> 'child_of'").select(F.col("target").alias("source"), F.col("source").alias("target")))


@query("SELECT id, type FROM thoughts WHERE type = 'task' AND status = 'active' UNION ALL SELECT id, type FROM thoughts WHERE type = 'idea' AND status = 'new' ORDER BY id")
def u03_union_sorted(t: Tables) -> DataFrame:
    return t.thoughts.where("(type = 'task' AND status = 'active') OR (type = 'idea' AND status = 'new')").orderBy("id").select("id", "type")


@query("SELECT id FROM thoughts WHERE importance > 80 AND id NOT IN (SELECT id FROM thoughts WHERE quality_score < 50)")
def u04_difference(t: Tables) -> DataFrame:
    return t.thoughts.where("importance > 80").select("id").subtract(t.thoughts.where("quality_score < 50").select("id"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_concat(topics, people, ['t1']))), ',') AS tags, list_contains(topics, 't1') AS has_t1 FROM thoughts")
def u05_array_sets(t: Tables) -> DataFrame:
    from engram.functions.values import merged_list

    tags = F.array_union(merged_list(F.col("topics"), F.col("people")), F.array(F.lit("t1")))
    return t.thoughts.select("id", F.array_join(F.array_sort(tags), ",").alias("tags"), F.array_contains("topics", "t1").alias("has_t1"))


@query("SELECT id FROM thoughts WHERE importance > 50 INTERSECT SELECT id FROM thoughts WHERE quality_score > 50")
def u06_intersect(t: Tables) -> DataFrame:
    return t.thoughts.where("importance > 50").select("id").intersect(t.thoughts.where("quality_score > 50").select("id"))


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1")
def w01_latest_per_group(t: Tables) -> DataFrame:
    return latest(t.events, ["event_type", "user_id"], [F.desc("value"), F.desc_nulls_last("ts"), F.desc("event_id")]).select("event_type", "event_id", "user_id")


@query("SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM thoughts) WHERE rank <= 25")
def w02_rank(t: Tables) -> DataFrame:
    top = t.thoughts.orderBy(F.desc("importance"), "id").limit(25)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("importance"), "id")).cast("bigint").alias("rank"))


@query("SELECT from_id, to_id, relation, support FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY support DESC, from_id, to_id) AS n FROM edges) WHERE n <= 12")
def w03_top_per_relation(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("support"), "from_id", "to_id"))
    return t.edges.withColumn("n", n).where("n <= 12").select("from_id", "to_id", "relation", "support")


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s)
SELECT user_id, session, COUNT(*) AS events, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM n GROUP BY 1, 2""")
def w04_sessions(t: Tables) -> DataFrame:
    from engram.operators.windows import sessions

    return sessions(t.events, "user_id", "ts", "event_id", hours=4).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS batch FROM events)
SELECT user_id, CAST(batch AS BIGINT) AS batch, COUNT(*) AS items, MIN(ts) AS first_ts, MAX(ts) AS last_ts, string_agg(event_type, ' ' ORDER BY ts, event_id) AS joined FROM n GROUP BY 1, 2""")
def w05_batches(t: Tables) -> DataFrame:
    from engram.operators.windows import batches

    rows = batches(t.events, ["user_id"], ["ts", "event_id"], 20).groupBy("user_id", "batch")
    return rows.agg(F.count("*").alias("items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), " ").alias("joined"))


@query("SELECT conv_id, first(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS first_answer FROM conversations GROUP BY conv_id")
def w06_first_non_null(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_answer"))


@query("SELECT id, CAST(unnest(range(1, len(topics) + 1)) AS BIGINT) AS place, unnest(topics) AS topic FROM thoughts")
def w07_ordinality(t: Tables) -> DataFrame:
    return t.thoughts.select("id", F.posexplode("topics").alias("at", "topic")).select("id", (F.col("at") + 1).cast("bigint").alias("place"), "topic")


@query("SELECT id, COUNT(*) OVER (PARTITION BY type) AS of_type FROM thoughts WHERE importance > 50")
def w08_total_per_row(t: Tables) -> DataFrame:
    return t.thoughts.where("importance > 50").select("id", F.count("*").over(Window.partitionBy("type")).alias("of_type"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 30")
def w09_cap_per_group(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("n", n).where("n <= 30").select("user_id", "event_id")


@query("""WITH RECURSIVE up AS (SELECT 900 % (SELECT COUNT(*) FROM documents) AS node, 0 AS depth UNION ALL SELECT node // 2, depth + 1 FROM up WHERE node >= 1)
SELECT CAST(node AS BIGINT) AS node, CAST((SELECT MAX(depth) FROM up) - depth AS BIGINT) AS place FROM up""")
def w10_branch(t: Tables) -> DataFrame:
    from engram.operators.graph import parent_chain

    start = 900 % t.documents.count()
    return parent_chain(t.documents.where("doc_id >= 1").selectExpr("doc_id AS node", "doc_id div 2 AS parent"), start)


@query("""WITH RECURSIVE tree AS (SELECT doc_id AS node, CASE WHEN doc_id % 7 = 0 THEN doc_id // 7 ELSE doc_id // 3 END AS parent FROM documents WHERE doc_id >= 1),
below AS (SELECT node AS top, node FROM tree UNION ALL SELECT top, t.node FROM below b JOIN tree t ON t.parent = b.node),
sizes AS (SELECT top AS node, COUNT(*) AS size FROM below GROUP BY 1),
best AS (SELECT parent, node FROM tree JOIN sizes USING (node) QUALIFY row_number() OVER (PARTITION BY parent ORDER BY size DESC, node) = 1),
walk AS (SELECT 1::BIGINT AS node, 0 AS place UNION ALL SELECT b.node, place + 1 FROM walk w JOIN best b ON b.parent = w.node)
SELECT node, CAST(place AS BIGINT) AS place FROM walk""")
def w10_largest_branch(t: Tables) -> DataFrame:
    """All documents as a tree of which each has up to four below it: from the first one down, to the largest subtree each time."""
    from engram.operators.graph import largest_paths

    links = t.documents.where("doc_id >= 1").selectExpr("1 AS tree", "doc_id AS node", "IF(doc_id % 7 = 0, doc_id div 7, doc_id div 3) AS parent")
    return largest_paths(links, ["tree"], [F.col("node")]).select("node", "place")


@query()
def w11_adaptive_threshold(t: Tables) -> DataFrame:
    from engram.operators.windows import adaptive_threshold

    return adaptive_threshold(t.events.withColumn("accepted", F.col("value") >= 5), "event_type", ["ts", "event_id"], "accepted")


@query("SELECT doc_id AS id, fp FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fp, row_number() OVER (PARTITION BY sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) ORDER BY (doc_id * 37) % 101 DESC, doc_id) AS n FROM documents) WHERE n = 1")
def w12_survivors(t: Tables) -> DataFrame:
    rows = t.thoughts.select("id", "quality_score", X.fingerprint(F.col("content")).alias("fp"))
    return latest(rows, ["fp"], [F.desc("quality_score"), F.col("id")]).select("id", "fp")


@query("SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS quarter FROM events")
def w13_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query("SELECT id, created_at FROM thoughts ORDER BY created_at DESC, id DESC LIMIT 15")
def o01_newest(t: Tables) -> DataFrame:
    return t.thoughts.orderBy(F.desc("created_at"), F.desc("id")).limit(15).select("id", "created_at")


@query("SELECT id, status, importance FROM thoughts ORDER BY status NULLS LAST, importance DESC NULLS FIRST, id LIMIT 120")
def o02_null_order(t: Tables) -> DataFrame:
    return t.thoughts.orderBy(F.asc_nulls_last("status"), F.desc_nulls_first("importance"), "id").limit(120).select("id", "status", "importance")


@query("SELECT id, importance FROM thoughts WHERE sensitivity_tier <> 'restricted' ORDER BY importance, id LIMIT 20")
def o03_allowed_sort(t: Tables) -> DataFrame:
    from engram.operators.filters import page_thoughts

    return page_thoughts(t.thoughts, sort="importance", descending=False).select("id", "importance")


@query("SELECT id FROM thoughts WHERE sensitivity_tier <> 'restricted' ORDER BY created_at DESC, id DESC LIMIT 100")
def o04_clamped_limit(t: Tables) -> DataFrame:
    from engram.operators.filters import page_thoughts

    return page_thoughts(t.thoughts, per_page=5000).select("id")


@query("""WITH n AS (SELECT COUNT(*) FILTER (WHERE importance >= 90) AS c FROM thoughts) SELECT id, importance FROM thoughts, n WHERE importance >= 90 OR c < 10 ORDER BY importance DESC, created_at DESC, id LIMIT 60""")
def o05_digest_rank(t: Tables) -> DataFrame:
    from engram.operators.windows import digest

    return digest(t.thoughts, 90, 10, 60, 60).select("id", "importance")


@query("SELECT id, type, CAST(list_position(['decision', 'task', 'idea'], type) AS BIGINT) AS place FROM thoughts WHERE type IN ('decision', 'task', 'idea') ORDER BY place, id LIMIT 80")
def o06_canonical_order(t: Tables) -> DataFrame:
    at = F.array_position(F.array(F.lit("decision"), F.lit("task"), F.lit("idea")), F.col("type"))
    return t.thoughts.select("id", "type", at.alias("place")).where("place > 0").orderBy("place", "id").limit(80)


@query("SELECT id, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages FROM (SELECT id, COUNT(*) OVER () AS total FROM thoughts WHERE importance > 10) ORDER BY id DESC LIMIT 20 OFFSET 40")
def o07_pages(t: Tables) -> DataFrame:
    rows = t.thoughts.where("importance > 10")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("id")).offset(40).limit(20).crossJoin(F.broadcast(total)).select("id", "total", F.ceil(F.col("total") / 20).alias("pages"))


@query("SELECT id, type FROM thoughts WHERE substring(md5(CAST(id AS VARCHAR)), 1, 1) IN ('0', '1')")
def o08_hash_sample(t: Tables) -> DataFrame:
    """An eighth of the thoughts, the same ones each time."""
    return t.thoughts.where(F.substring(F.md5(F.col("id").cast("string")), 1, 1).isin("0", "1")).select("id", "type")

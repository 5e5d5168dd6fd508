"""Queries: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import values as V
from engram.operators import stats as A
from engram.plans.views import AS_OF, Tables, query

TIME = f"TIMESTAMP '{AS_OF}'"
TODAY = "2001-09-01"
_FP = "sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))"
_WORDS = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query(f"""WITH r AS (SELECT * FROM thoughts WHERE sensitivity_tier IS DISTINCT FROM 'restricted'), w AS (SELECT * FROM r WHERE created_at >= {TIME} - INTERVAL 50 DAY)
SELECT 'total' AS section, NULL AS key, COUNT(*) AS n FROM r UNION ALL SELECT * FROM (SELECT 'type', type, COUNT(*) AS n FROM w GROUP BY type ORDER BY n DESC, type LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'topic', topic, COUNT(*) AS n FROM (SELECT unnest(topics) AS topic FROM w) GROUP BY topic ORDER BY n DESC, topic LIMIT 20)""")
def a01_brain_stats(t: Tables) -> DataFrame:
    return A.brain_stats(t.thoughts, AS_OF, 50)


_SUMMARY = """SELECT 'total' AS section, NULL AS key, COUNT(*) AS n FROM thoughts UNION ALL SELECT 'first', strftime(MIN(created_at), '%Y-%m-%d %H:%M:%S'), COUNT(*) FROM thoughts
UNION ALL SELECT 'last', strftime(MAX(created_at), '%Y-%m-%d %H:%M:%S'), COUNT(*) FROM thoughts UNION ALL SELECT 'type', type, COUNT(*) FROM thoughts GROUP BY type
UNION ALL SELECT * FROM (SELECT 'topics', topic, COUNT(*) AS n FROM (SELECT unnest(topics) AS topic FROM thoughts) GROUP BY topic ORDER BY n DESC, topic LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'people', person, COUNT(*) AS n FROM (SELECT unnest(people) AS person FROM thoughts) GROUP BY person ORDER BY n DESC, person LIMIT 10)"""


@query(_SUMMARY)
def a02_stats_summary(t: Tables) -> DataFrame:
    return A.stats_summary(t.thoughts)


@query(_SUMMARY)
def a03_thought_stats(t: Tables) -> DataFrame:
    return A.stats_summary(t.thoughts, 10)


@query("SELECT source_type, type, COUNT(*) AS thoughts FROM thoughts GROUP BY ALL")
def a04_by_source_and_type(t: Tables) -> DataFrame:
    return t.thoughts.groupBy("source_type", "type").agg(F.count("*").alias("thoughts"))


@query("SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'done') AS done, COUNT(*) FILTER (WHERE sensitivity_tier IS NULL) AS untiered FROM thoughts WHERE importance > 10")
def a05_exact_counts(t: Tables) -> DataFrame:
    return t.thoughts.where("importance > 10").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("sensitivity_tier").isNull()).alias("untiered"))


@query("SELECT done, open, ROUND(100.0 * done / (done + open), 6) AS percent, ROUND(open / 120.0, 6) AS hours FROM (SELECT COUNT(*) FILTER (WHERE quality IS NOT NULL) AS done, COUNT(*) FILTER (WHERE quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id))")
def a06_enrichment_status(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return A.share_done(rows, F.col("quality").isNotNull(), 120)


@query(f"SELECT fp, COUNT(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT doc_id, {_FP} AS fp FROM documents) GROUP BY fp HAVING COUNT(*) > 1")
def a07_duplicate_groups(t: Tables) -> DataFrame:
    groups = t.documents.select("doc_id", X.fingerprint(F.col("text")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.where("n > 1").select("fp", "n", F.array_join("ids", ",").alias("ids"))


@query("SELECT entity_id, COUNT(*) AS links FROM thought_entities GROUP BY entity_id HAVING COUNT(*) >= 3 ORDER BY links DESC, entity_id LIMIT 50")
def a08_entities_with_links(t: Tables) -> DataFrame:
    return t.thought_entities.groupBy("entity_id").agg(F.count("*").alias("links")).where("links >= 3").orderBy(F.desc("links"), "entity_id").limit(50)


@query("SELECT relation, COUNT(*) AS edges, CAST(SUM(support) AS BIGINT) AS support, ROUND(AVG(confidence), 2) AS confidence FROM edges GROUP BY relation")
def a09_relations(t: Tables) -> DataFrame:
    return t.edges.groupBy("relation").agg(F.count("*").alias("edges"), F.sum("support").alias("support"), F.round(F.avg("confidence"), 2).alias("confidence"))


@query("SELECT relation, COUNT(*) AS n FROM graph_edges GROUP BY relation ORDER BY n DESC, relation")
def a10_edge_types(t: Tables) -> DataFrame:
    return t.graph_edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")


@query(f"""SELECT stage, COUNT(*) AS applications, COUNT(*) FILTER (WHERE occurred_on >= DATE '{TODAY}' - 90) AS recent FROM interactions GROUP BY stage
UNION ALL SELECT 'total', COUNT(*), COUNT(*) FILTER (WHERE occurred_on >= DATE '{TODAY}' - 90) FROM interactions""")
def a11_pipeline(t: Tables) -> DataFrame:
    recent = F.count_if(F.col("occurred_on") >= F.date_add(F.to_date(F.lit(TODAY)), -90)).alias("recent")
    return t.interactions.rollup("stage").agg(F.count("*").alias("applications"), recent).withColumn("stage", F.coalesce("stage", F.lit("total")))


@query(f"""SELECT contact_id, COUNT(*) FILTER (WHERE follow_up_needed) AS pending, CAST(DATE '{TODAY}' - MAX(occurred_on) AS BIGINT) AS days_since, COUNT(*) FILTER (WHERE stage = 'proposal') AS active,
ROUND(COALESCE(SUM(value) FILTER (WHERE stage = 'proposal'), 0), 2) AS pipeline FROM interactions GROUP BY contact_id""")
def a12_contact_prep(t: Tables) -> DataFrame:
    active = F.col("stage") == "proposal"
    return t.interactions.groupBy("contact_id").agg(
        F.count_if("follow_up_needed").alias("pending"), F.date_diff(F.to_date(F.lit(TODAY)), F.max("occurred_on")).cast("bigint").alias("days_since"), F.count_if(active).alias("active"),
        F.round(F.coalesce(F.sum(F.when(active, F.col("value"))), F.lit(0.0)), 2).alias("pipeline"),
    )


@query("SELECT name, unit, string_agg(quantity, ' + ' ORDER BY meal_id, place, quantity) AS quantities, MIN(meal_id) AS first_meal FROM ingredients GROUP BY name, unit")
def a13_shopping_list(t: Tables) -> DataFrame:
    return A.shopping_list(t.ingredients)


@query("SELECT CAST(ts AS DATE) AS day, COUNT(*) AS events, string_agg(event_type, ',' ORDER BY ts, event_id) AS titles FROM events GROUP BY day")
def a14_by_day(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("all"))
    return rows.select("day", "events", F.array_join("all.event_type", ",").alias("titles"))


_THREADS = f"SELECT conv_id, COUNT(*) AS messages, CAST(SUM(atoms) AS BIGINT) AS atoms, CAST(SUM(words) AS BIGINT) AS words FROM (SELECT conv_id, turn // 2 AS message, COUNT(*) AS atoms, MAX({_WORDS}) AS words FROM conversations GROUP BY 1, 2) GROUP BY conv_id"


def _threads(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.expr("turn div 2").alias("message"), X.word_count(F.col("text")).alias("words"))
    return A.threads(rows, "conv_id", "message", "words")


@query(_THREADS)
def a15_threads(t: Tables) -> DataFrame:
    return _threads(t)


@query(f"SELECT conv_id FROM ({_THREADS}) WHERE words >= 200 AND (messages >= 2 OR atoms >= 3)")
def a16_eligible_threads(t: Tables) -> DataFrame:
    return _threads(t).where("words >= 200 AND (messages >= 2 OR atoms >= 3)").select("conv_id")


_META = "CASE id % 5 WHEN 0 THEN '{\"original_date\": \"2019-03-04T10:00\"}' WHEN 1 THEN '{\"sent_at\": \"2021-11-30\"}' WHEN 2 THEN '{\"date\": \"n/a\"}' WHEN 3 THEN '{\"date\": \"1999-01-01\", \"sent_at\": \"x\"}' ELSE '{}' END"


@query("""SELECT CASE id % 5 WHEN 0 THEN 2019 WHEN 1 THEN 2021 WHEN 3 THEN 1999 ELSE year(created_at) END AS year, CAST(least(COUNT(*), 100) AS BIGINT) AS thoughts FROM thoughts GROUP BY 1""")
def a17_by_life_year(t: Tables) -> DataFrame:
    at = V.life_date(F.expr(_META), ["original_date", "date", "sent_at"], F.col("created_at"))
    rows = t.thoughts.select("id", F.year(at).cast("bigint").alias("year")).where("year BETWEEN 1900 AND 2099")
    return A.capped(rows, ["year"], [F.col("id")], 100).groupBy("year").agg(F.count("*").alias("thoughts"))


@query("""WITH s AS (SELECT lesson_id, COUNT(*) AS attempts, round(100.0 * COUNT(*) FILTER (WHERE is_correct) / COUNT(*)) AS score, COUNT(*) FILTER (WHERE flagged) AS follow_ups FROM answers GROUP BY lesson_id)
SELECT CAST(COUNT(*) AS BIGINT) AS lessons, COUNT(*) FILTER (WHERE score >= 80) AS completed, round(AVG(score)) AS average, CAST(SUM(attempts) AS BIGINT) AS attempts, CAST(SUM(follow_ups) AS BIGINT) AS follow_ups, MIN(CASE WHEN score < 80 THEN lesson_id END) AS next_lesson FROM s""")
def a18_learning_dashboard(t: Tables) -> DataFrame:
    s = t.answers.groupBy("lesson_id").agg(F.count("*").alias("attempts"), F.round(100.0 * F.count_if("is_correct") / F.count("*")).alias("score"), F.count_if("flagged").alias("follow_ups"))
    done = F.col("score") >= 80
    return s.agg(F.count("*").alias("lessons"), F.count_if(done).alias("completed"), F.round(F.avg("score")).alias("average"), F.sum("attempts").alias("attempts"), F.sum("follow_ups").alias("follow_ups"), F.min(F.when(~done, F.col("lesson_id"))).alias("next_lesson"))


@query("""SELECT lesson_id, COUNT(*) AS quizzes, ROUND(AVG(score), 6) AS average, MAX(score) AS best FROM (SELECT lesson_id, quiz_id, round(100.0 * COUNT(*) FILTER (WHERE is_correct) / COUNT(*)) AS score FROM answers GROUP BY 1, 2) GROUP BY 1""")
def a19_quiz_scores(t: Tables) -> DataFrame:
    return A.quiz_scores(t.answers)


@query("SELECT lesson_id, COUNT(*) FILTER (WHERE flagged AND NOT is_correct) AS open, COUNT(*) FILTER (WHERE flagged AND is_correct) AS closed FROM answers GROUP BY lesson_id")
def a20_follow_ups(t: Tables) -> DataFrame:
    return t.answers.groupBy("lesson_id").agg(F.count_if(F.col("flagged") & ~F.col("is_correct")).alias("open"), F.count_if(F.col("flagged") & F.col("is_correct")).alias("closed"))


@query("SELECT type, ROUND(AVG(importance), 6) AS relevance, ROUND(AVG(quality_score), 6) AS depth, ROUND((AVG(importance) + AVG(quality_score)) / 2, 6) AS composite FROM thoughts GROUP BY type")
def a21_eval_means(t: Tables) -> DataFrame:
    a, b = F.avg("importance"), F.avg("quality_score")
    return t.thoughts.groupBy("type").agg(F.round(a, 6).alias("relevance"), F.round(b, 6).alias("depth"), F.round((a + b) / 2, 6).alias("composite"))


@query("""SELECT 'rows' AS section, NULL AS key, COUNT(*) AS n FROM conversations UNION ALL SELECT 'threads', NULL, COUNT(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'empty', NULL, COUNT(*) FILTER (WHERE trim(text) = '') FROM conversations
UNION ALL SELECT 'role', role, COUNT(*) FROM conversations GROUP BY role UNION ALL SELECT * FROM (SELECT 'top', CAST(conv_id AS VARCHAR), COUNT(*) AS n FROM conversations GROUP BY conv_id ORDER BY n DESC, CAST(conv_id AS VARCHAR) LIMIT 10)""")
def a22_mail_audit(t: Tables) -> DataFrame:
    c = t.conversations
    facts = c.agg(F.count("*").alias("rows"), F.count_distinct("conv_id").alias("threads"), F.count_if(F.trim("text") == "").alias("empty"))
    one = facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(None).cast("string").alias("key"), F.col(k).alias("n")) for k in ("rows", "threads", "empty")])).alias("r")).select("r.*")
    return one.unionByName(A.top_counts(c, "role", "role")).unionByName(A.top_counts(c, F.col("conv_id").cast("string"), "top", 10))


@query("SELECT CASE WHEN length(text) < 120 THEN 'too_short' WHEN doc_id % 11 = 0 THEN 'template' WHEN doc_id % 7 = 0 THEN 'unchanged' ELSE 'imported' END AS reason, COUNT(*) AS n FROM documents GROUP BY 1")
def a23_import_report(t: Tables) -> DataFrame:
    from engram.operators.filters import first_reason

    rules = [("too_short", F.length("text") < 120), ("template", F.col("doc_id") % 11 == 0), ("unchanged", F.col("doc_id") % 7 == 0)]
    return t.documents.groupBy(F.coalesce(first_reason(rules), F.lit("imported")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS category, COUNT(*) FILTER (WHERE value < 3) AS low, COUNT(*) FILTER (WHERE value >= 3 AND value < 8) AS medium, COUNT(*) FILTER (WHERE value >= 8) AS high FROM events GROUP BY 1")
def a24_findings(t: Tables) -> DataFrame:
    severity = F.when(F.col("value") < 3, "low").when(F.col("value") < 8, "medium").otherwise("high")
    return t.events.withColumn("severity", severity).groupBy(F.col("event_type").alias("category")).pivot("severity", ["low", "medium", "high"]).count().na.fill(0)


@query("SELECT CASE WHEN status IS NULL THEN 'null' WHEN status = 'done' THEN 'already' WHEN status IN ('new', 'active') THEN 'updated' ELSE 'invalid' END AS outcome, COUNT(*) AS n FROM thoughts GROUP BY 1")
def a25_type_backfill(t: Tables) -> DataFrame:
    s = F.col("status")
    outcome = F.when(s.isNull(), "null").when(s == "done", "already").when(s.isin("new", "active"), "updated").otherwise("invalid")
    return t.thoughts.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT contact_id, COUNT(*) AS highlights, MAX(occurred_on) AS latest FROM interactions GROUP BY contact_id")
def a26_per_book(t: Tables) -> DataFrame:
    return t.interactions.groupBy("contact_id").agg(F.count("*").alias("highlights"), F.max("occurred_on").alias("latest"))


@query("SELECT name, n FROM (SELECT contact_id, COUNT(*) AS n FROM interactions GROUP BY contact_id ORDER BY n DESC, contact_id LIMIT 10) JOIN contacts USING (contact_id)")
def a27_top_correspondents(t: Tables) -> DataFrame:
    top = t.interactions.groupBy("contact_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contact_id").limit(10)
    return top.join(t.contacts, "contact_id").select("name", "n")


@query("SELECT COUNT(DISTINCT conv_id) AS threads, COUNT(DISTINCT role) AS roles FROM conversations")
def a28_distinct(t: Tables) -> DataFrame:
    return t.conversations.agg(F.count_distinct("conv_id").alias("threads"), F.count_distinct("role").alias("roles"))


@query("""SELECT type, string_agg(CAST(id AS VARCHAR), ',' ORDER BY importance DESC, id) AS ids FROM thoughts WHERE importance > 70 GROUP BY type""")
def a29_json_list(t: Tables) -> DataFrame:
    rows = t.thoughts.where("importance > 70").groupBy("type").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "id"))).alias("all"))
    return rows.select("type", F.array_join("all.id", ",").alias("ids"))


@query("SELECT event_type, CAST(user_id % 2 AS BIGINT) AS model, COUNT(*) AS outcomes, ROUND(AVG(CASE WHEN value >= 5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY 1, 2")
def a30_accuracy(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", (F.col("user_id") % 2).alias("model")).agg(F.count("*").alias("outcomes"), F.round(F.avg((F.col("value") >= 5).cast("double")), 6).alias("accuracy"))


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2")
def a31_per_day(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.window("ts", "1 day")["start"].alias("day")).agg(F.count("*").alias("n"))


@query("SELECT type, lang, COUNT(*) AS n, CAST(grouping(type) + grouping(lang) AS BIGINT) AS level FROM thoughts GROUP BY CUBE (type, lang)")
def a32_cube(t: Tables) -> DataFrame:
    return t.thoughts.cube("type", "lang").agg(F.count("*").alias("n"), (F.grouping("type") + F.grouping("lang")).cast("bigint").alias("level"))

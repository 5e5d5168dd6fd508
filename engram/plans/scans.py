"""Queries: scans, filters and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import filters as P
from engram.plans.views import AS_OF, Tables, query

TIME = f"TIMESTAMP '{AS_OF}'"
#: Days of the order tables' clock.
TODAY = "2001-07-15"


@query("SELECT id, type, source_type, COUNT(*) OVER () AS total FROM thoughts")
def s01_table_scan(t: Tables) -> DataFrame:
    total = t.thoughts.agg(F.count("*").alias("total"))
    return t.thoughts.select("id", "type", "source_type").crossJoin(F.broadcast(total))


@query("SELECT id, source_type FROM thoughts ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def s02_offset_page(t: Tables) -> DataFrame:
    return t.thoughts.orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50).select("id", "source_type")


@query("SELECT id, lang FROM thoughts WHERE id > 40 ORDER BY id LIMIT 25")
def s03_keyset_page(t: Tables) -> DataFrame:
    return t.thoughts.where("id > 40").orderBy("id").limit(25).select("id", "lang")


@query("SELECT id, lang FROM thoughts WHERE created_at < TIMESTAMP '2024-01-05 00:00:00' OR (created_at = TIMESTAMP '2024-01-05 00:00:00' AND id < 90) ORDER BY created_at DESC, id DESC LIMIT 60")
def s04_composite_keyset(t: Tables) -> DataFrame:
    at = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return P.newest(t.thoughts.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < 90))), 60).select("id", "lang")


@query("SELECT id, type FROM thoughts WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s05_ids_lookup(t: Tables) -> DataFrame:
    return t.thoughts.join(t.labels.where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "type")


@query("SELECT id, content, type FROM thoughts WHERE id = 42")
def s06_point_lookup(t: Tables) -> DataFrame:
    return t.thoughts.where("id = 42").select("id", "content", "type")


@query("SELECT doc_id AS thought_id, 'pending' AS status FROM labels WHERE toxic = 0 ORDER BY doc_id LIMIT 20")
def s26_queue_peek(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 0").orderBy("doc_id").limit(20).select(F.col("doc_id").alias("thought_id"), F.lit("pending").alias("status"))


@query(f"SELECT id, type FROM thoughts WHERE type = 'idea' AND list_contains(topics, 't3') AND created_at >= {TIME} - INTERVAL 60 DAY ORDER BY created_at DESC, id DESC LIMIT 10")
def p01_list_thoughts(t: Tables) -> DataFrame:
    return P.list_thoughts(t.thoughts, AS_OF, 10, kind="idea", topic="t3", days=60).select("id", "type")


@query("SELECT id, type FROM thoughts WHERE list_contains(people, 'p2') ORDER BY created_at DESC, id DESC LIMIT 15")
def p02_list_by_person(t: Tables) -> DataFrame:
    return P.list_thoughts(t.thoughts, AS_OF, 15, person="p2").select("id", "type")


@query("""SELECT id, type, importance, quality_score FROM thoughts WHERE status IN ('new', 'active') AND importance >= 20 AND quality_score <= 90 AND sensitivity_tier <> 'restricted'
ORDER BY importance DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20""")
def p03_page_thoughts(t: Tables) -> DataFrame:
    return P.page_thoughts(t.thoughts, statuses=("new", "active"), importance_min=20, quality_max=90, sort="importance", page=2).select("id", "type", "importance", "quality_score")


@query("SELECT contact_id, name, balance FROM contacts WHERE company IN ('BUILDING', 'MACHINERY') AND balance > 100 AND balance <= 5000 AND nation_id <> 3 AND name IS NOT NULL")
def p04_comparisons(t: Tables) -> DataFrame:
    c = t.contacts
    return c.where(F.col("company").isin("BUILDING", "MACHINERY") & (F.col("balance") > 100) & (F.col("balance") <= 5000) & (F.col("nation_id") != 3) & F.col("name").isNotNull()).select("contact_id", "name", "balance")


@query("SELECT contact_id, name, company FROM contacts WHERE name ILIKE '%0007%' OR company ILIKE '%mach%'")
def p05_any_column_like(t: Tables) -> DataFrame:
    return t.contacts.where(P.any_like(["name", "company"], "0007") | P.any_like(["company"], "mach")).select("contact_id", "name", "company")


@query("SELECT id, source_type FROM thoughts WHERE source_type LIKE 'src1%'")
def p06_prefix(t: Tables) -> DataFrame:
    return t.thoughts.where(F.col("source_type").startswith("src1")).select("id", "source_type")


@query("SELECT id FROM thoughts WHERE list_has_all(topics, ['t2', 'u5'])")
def p07_array_contains_all(t: Tables) -> DataFrame:
    return t.thoughts.where(P.has_all(F.col("topics"), ["t2", "u5"])).select("id")


@query("""SELECT id FROM metadata_thoughts WHERE json_extract_string(metadata, '$.type') = 'task' AND json_contains(json_extract(metadata, '$.topics'), '"t1"') AND json_extract_string(metadata, '$.origin.lang') = 'en'""")
def p08_json_contains(t: Tables) -> DataFrame:
    return t.metadata_thoughts.where(P.contains_json(F.col("metadata"), {"type": "task", "topics": ["t1"], "origin": {"lang": "en"}})).select("id")


@query("SELECT id, sensitivity_tier <> 'restricted' AS by_neq, sensitivity_tier IS DISTINCT FROM 'restricted' AS by_distinct, sensitivity_tier IS DISTINCT FROM 'restricted' AS by_either FROM thoughts")
def p09_restricted_filters(t: Tables) -> DataFrame:
    return t.metadata_thoughts.select("id", P.not_restricted("neq").alias("by_neq"), P.not_restricted().alias("by_distinct"), P.not_restricted("or_metadata").alias("by_either"))


@query("SELECT id, sensitivity_tier FROM thoughts WHERE sensitivity_tier IS NULL OR sensitivity_tier NOT IN ('restricted', 'personal')")
def p10_digest_tiers(t: Tables) -> DataFrame:
    return t.thoughts.where(P.tier_not_in(["restricted", "personal"])).select("id", "sensitivity_tier")


@query(f"""SELECT name, CAST(COUNT(*) FILTER (WHERE days IS NULL OR created_at >= {TIME} - INTERVAL (days) DAY) AS BIGINT) AS thoughts
FROM thoughts, (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('90d', 90), ('1y', 365), ('all', NULL)) w(name, days) GROUP BY name""")
def p11_time_windows(t: Tables) -> DataFrame:
    windows = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": None}
    counts = t.thoughts.agg(*[F.count_if(P.since(F.col("created_at"), AS_OF, d)).alias(n) for n, d in windows.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("thoughts")) for n in windows])).alias("w")).select("w.*")


@query(f"""SELECT interaction_id, CASE WHEN due < DATE '{TODAY}' THEN 'overdue' ELSE 'upcoming' END AS state
FROM (SELECT *, occurred_on + 30 AS due FROM interactions WHERE follow_up_needed) WHERE due <= DATE '{TODAY}' + 14 AND due >= DATE '{TODAY}' - 60""")
def p12_due_split(t: Tables) -> DataFrame:
    due = t.interactions.where("follow_up_needed").withColumn("due", F.date_add("occurred_on", 30))
    return due.where(f"due <= date_add(DATE'{TODAY}', 14) AND due >= date_add(DATE'{TODAY}', -60)").select("interaction_id", P.due_split(F.col("due"), TODAY).alias("state"))


@query(f"""SELECT contact_id, name, last_contacted FROM contacts LEFT JOIN (SELECT contact_id AS cid, MAX(occurred_on) AS last_contacted FROM interactions GROUP BY 1) ON cid = contact_id
WHERE last_contacted IS NULL OR last_contacted < DATE '{TODAY}' - 90 ORDER BY last_contacted NULLS FIRST, contact_id LIMIT 40""")
def p13_stale_contacts(t: Tables) -> DataFrame:
    last = t.interactions.groupBy("contact_id").agg(F.max("occurred_on").alias("last_contacted"))
    stale = t.contacts.join(last, "contact_id", "left").where(F.col("last_contacted").isNull() | (F.col("last_contacted") < F.date_add(F.to_date(F.lit(TODAY)), -90)))
    return stale.orderBy(F.asc_nulls_first("last_contacted"), "contact_id").limit(40).select("contact_id", "name", "last_contacted")


@query("""SELECT task_id, log_id, line FROM (SELECT *, CASE WHEN line % 3 = 0 THEN NULL ELSE completed_on + 10 END AS until, line = 7 AND log_id % 50 = 0 AS recurring FROM task_logs)
WHERE (completed_on <= DATE '1998-06-07' AND (until >= DATE '1998-06-01' OR (until IS NULL AND completed_on >= DATE '1998-05-01'))) OR recurring""")
def p14_interval_overlap(t: Tables) -> DataFrame:
    rows = t.task_logs.selectExpr("*", "IF(line % 3 = 0, NULL, date_add(completed_on, 10)) AS until", "line = 7 AND log_id % 50 = 0 AS recurring")
    recent = F.col("recurring") | F.col("until").isNotNull() | (F.col("completed_on") >= F.to_date(F.lit("1998-05-01")))
    return rows.where(P.overlaps(F.col("completed_on"), F.col("until"), "1998-06-01", "1998-06-07", F.col("recurring")) & recent).select("task_id", "log_id", "line")


@query("SELECT memory_id, workspace_id FROM agent_memories WHERE workspace_id IN (SELECT concat('w', c_nationkey % 3) FROM customer WHERE c_custkey = 7) AND (visibility <> 'personal' OR memory_id % 4 = 1)")
def p15_row_policies(t: Tables) -> DataFrame:
    mine = t.customer.where("c_custkey = 7").select(F.concat(F.lit("w"), F.col("c_nationkey") % 3).alias("workspace_id"))
    return t.agent_memories.join(mine, "workspace_id", "left_semi").where("visibility <> 'personal' OR memory_id % 4 = 1").select("memory_id", "workspace_id")


@query("SELECT interaction_id, occurred_on FROM interactions WHERE occurred_on BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'")
def p16_date_range(t: Tables) -> DataFrame:
    return t.interactions.where(F.col("occurred_on").between(F.to_date(F.lit("2001-06-01")), F.to_date(F.lit("2001-06-30")))).select("interaction_id", "occurred_on")


@query("""SELECT memory_id, array_to_string(list_filter([CASE WHEN NOT (confidence BETWEEN 0.1 AND 0.9) THEN 'confidence' END, CASE WHEN NOT (provenance_status IN ('user_confirmed', 'imported', 'observed', 'generated')) THEN 'provenance' END,
CASE WHEN NOT (NOT can_use_as_instruction OR provenance_status IN ('user_confirmed', 'imported')) THEN 'instruction_policy' END], lambda x: x IS NOT NULL), ',') AS broken FROM agent_memories""")
def p17_constraint_report(t: Tables) -> DataFrame:
    checks = {
        "confidence": F.col("confidence").between(0.1, 0.9),
        "provenance": F.col("provenance_status").isin("user_confirmed", "imported", "observed", "generated"),
        "instruction_policy": ~F.col("can_use_as_instruction") | F.col("provenance_status").isin("user_confirmed", "imported"),
    }
    return t.agent_memories.select("memory_id", F.array_join(P.violations(checks), ",").alias("broken"))


@query("""SELECT memory_id FROM agent_memories WHERE workspace_id = 'w1' AND project_id = 'p1' AND lifecycle_status NOT IN ('stale', 'superseded', 'rejected', 'disputed')
AND NOT (requires_user_confirmation AND review_status = 'pending') AND visibility <> 'personal'""")
def p18_recall_scope(t: Tables) -> DataFrame:
    return t.agent_memories.where(P.scope_matches("w1", "p1", project_only=True)).select("memory_id")


_CATEGORY = "CASE doc_id % 4 WHEN 0 THEN 'Maps' WHEN 1 THEN 'YouTube' WHEN 2 THEN 'Chrome' ELSE 'Search' END"
_TITLE = "concat(CASE doc_id % 7 WHEN 0 THEN 'Visited ' WHEN 1 THEN 'Watched ' WHEN 2 THEN 'Searched for ' WHEN 3 THEN '12 notification ' WHEN 4 THEN 'Directions to ' ELSE '' END, substring(text, 1, CAST(doc_id % 40 AS INT)))"


@query(f"""SELECT doc_id, title FROM (SELECT doc_id, {_TITLE} AS title, {_CATEGORY} AS category FROM documents) WHERE length(title) >= 10 AND NOT regexp_matches(title, '^[0-9]+ notification')
AND NOT (category = 'Maps' AND (regexp_matches(title, '^(Visited |Viewed |Used maps|Opened )') OR (NOT regexp_matches(title, '^(Searched for|Direction|Navigat)') AND length(title) < 30)))
AND NOT (category = 'YouTube' AND ((starts_with(title, 'Watched ') AND length(title) < 40) OR starts_with(title, 'Visited '))) AND NOT (category = 'Chrome' AND length(title) < 15)""")
def p19_activity_filter(t: Tables) -> DataFrame:
    rows = t.documents.selectExpr("doc_id", f"{_TITLE} AS title", f"{_CATEGORY} AS category")
    return rows.where(P.keeps_activity(F.col("title"), F.col("category"))).select("doc_id", "title")


_WORDS = "len(list_filter(string_split_regex({}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query(f"""SELECT conv_id, CASE WHEN conv_id % 17 = 0 THEN 'do_not_remember' WHEN messages < 3 THEN 'single_turn' WHEN messages < 7 AND conv_id % 5 = 0 AND messages <= 5 THEN 'untitled_short' WHEN messages < 7 AND words < 150 THEN 'too_little_text' END AS skip
FROM (SELECT conv_id, COUNT(*) AS messages, CAST(SUM({_WORDS.format('text')}) AS BIGINT) AS words FROM conversations GROUP BY conv_id)""")
def p20_conversation_skip(t: Tables) -> DataFrame:
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(X.word_count(F.col("text"))).alias("words"))
    title = F.when(F.col("conv_id") % 5 == 0, "").otherwise("title")
    return c.select("conv_id", P.conversation_skip(F.col("messages"), F.col("words"), title, F.col("conv_id") % 17 == 0, 3, 7, 150).alias("skip"))


@query("SELECT memory_id, CASE WHEN lifecycle_status = 'rejected' THEN 'deleted' WHEN review_status = 'rejected' THEN 'forgotten' WHEN provenance_status = 'imported' THEN 'already_imported' END AS skip FROM agent_memories")
def p21_memory_skip(t: Tables) -> DataFrame:
    rules = [("deleted", F.col("lifecycle_status") == "rejected"), ("forgotten", F.col("review_status") == "rejected"), ("already_imported", F.col("provenance_status") == "imported")]
    return t.agent_memories.select("memory_id", P.first_reason(rules).alias("skip"))


_SUBJECT = "CASE conv_id % 6 WHEN 0 THEN 'Your order' WHEN 1 THEN 'Payment failed' WHEN 2 THEN 'Lunch' WHEN 3 THEN 'Fwd: Verify your email now' WHEN 4 THEN 'Requests $25.00' ELSE 'unsubscribe' END"
_SENDER = "CASE turn % 4 WHEN 0 THEN 'No-Reply@x.org' WHEN 1 THEN 'ann@y.org' ELSE 'bob@z.org' END"


@query(f"""SELECT conv_id, turn, contains(lower(sender), 'no-reply') OR regexp_matches(lower(subject), '\\byour (order|booking|reservation|subscription)\\b|\\bpayment failed\\b|\\b(receipt|invoice|payment|autopay|billing)\\b|\\bverify your (email|account)\\b|\\brequests? \\$[0-9,.]+') OR lower(subject) = 'unsubscribe' OR (turn % 5 = 3) AS machine
FROM (SELECT conv_id, turn, {_SUBJECT} AS subject, {_SENDER} AS sender FROM conversations)""")
def p22_auto_mail(t: Tables) -> DataFrame:
    c = t.conversations
    return c.select("conv_id", "turn", P.auto_generated(F.expr(_SUBJECT), F.expr(_SENDER), F.when(F.col("turn") % 5 == 3, "auto-replied"), F.col("text")).alias("machine"))


@query("SELECT doc_id FROM documents WHERE length(text) >= 30 AND NOT starts_with(text, 'RT @')")
def p23_tweet_filter(t: Tables) -> DataFrame:
    return t.documents.where((F.length("text") >= 30) & ~F.col("text").startswith("RT @")).select("doc_id")


@query("SELECT id FROM thoughts WHERE lower(source_type) = 'src3' AND id > 10 AND id % 6 <> 0 AND created_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-02-20 00:00:00'")
def p24_highlight_filter(t: Tables) -> DataFrame:
    when = F.when(F.col("id") % 6 != 0, F.col("created_at"))
    return t.thoughts.where((F.lower("source_type") == "SRC3".lower()) & (F.col("id") > 10) & when.between(F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), F.lit("2024-02-20 00:00:00").cast("timestamp_ntz"))).select("id")


@query(f"""SELECT id, CASE WHEN {_WORDS.format('content')} < 30 THEN 'too_short' WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'unchanged' WHEN id % 23 = 0 THEN 'template' END AS skip FROM thoughts""")
def p25_note_filter(t: Tables) -> DataFrame:
    known = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("same")).distinct()
    rules = [("too_short", X.word_count(F.col("content")) < 30), ("unchanged", F.coalesce("same", F.lit(False))), ("template", F.col("id") % 23 == 0)]
    return t.thoughts.join(known, "id", "left").select("id", P.first_reason(rules).alias("skip"))


@query("SELECT id FROM thoughts WHERE type IN ('task', 'decision') AND len(list_filter(people, lambda x: contains(lower(x), 'p1'))) > 0 AND status IS DISTINCT FROM 'done' AND contains(lower(concat_ws(' ', type, status, array_to_string(topics, ' '))), 'u')")
def p26_operating_model_filter(t: Tables) -> DataFrame:
    words = F.lower(F.concat_ws(" ", "type", "status", F.array_join("topics", " ")))
    return t.thoughts.where(F.col("type").isin("task", "decision") & F.exists("people", lambda x: F.contains(F.lower(x), F.lit("p1"))) & ~F.col("status").eqNullSafe(F.lit("done")) & F.contains(words, F.lit("u"))).select("id")


@query(f"SELECT id FROM thoughts WHERE created_at >= {TIME} - INTERVAL 45 DAY AND coalesce(status, '') NOT IN ('done', 'review') AND type NOT IN ('journal') ORDER BY created_at, id")
def p27_audit_corpus(t: Tables) -> DataFrame:
    return t.thoughts.where(P.since(F.col("created_at"), AS_OF, 45) & ~F.coalesce("status", F.lit("")).isin("done", "review") & ~F.col("type").isin("journal")).orderBy("created_at", "id").select("id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 7")
def p28_recent_reports(t: Tables) -> DataFrame:
    return P.newest(t.events.where("event_type = 'error'"), P.clamp(7, 1, 1000, 5), "ts", "event_id").select("event_id", "event_type")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS location FROM events WHERE user_id = 5 ORDER BY location NULLS LAST, event_id LIMIT 100")
def p29_highlights_of(t: Tables) -> DataFrame:
    at = F.get_json_object("props", "$.k").try_cast("bigint")
    return t.events.where("user_id = 5").select("event_id", at.alias("location")).orderBy(F.asc_nulls_last("location"), "event_id").limit(100)


@query("SELECT id FROM thoughts WHERE len(topics) = 0 AND len(people) = 0")
def p30_lint_no_tags(t: Tables) -> DataFrame:
    return t.thoughts.where((F.coalesce(F.size("topics"), F.lit(0)) == 0) & (F.coalesce(F.size("people"), F.lit(0)) == 0)).select("id")


@query("SELECT id, CAST(len(topics) + len(people) AS BIGINT) AS tags FROM thoughts WHERE len(topics) + len(people) > 2")
def p31_lint_many_tags(t: Tables) -> DataFrame:
    return t.thoughts.select("id", (F.size("topics") + F.size("people")).cast("bigint").alias("tags")).where("tags > 2")


@query("SELECT id FROM (SELECT id, CASE WHEN id % 97 = 0 THEN '  ' WHEN id % 89 = 0 THEN NULL ELSE content END AS content FROM thoughts) WHERE content IS NULL OR trim(content) = ''")
def p32_lint_empty(t: Tables) -> DataFrame:
    content = F.when(F.col("id") % 97 == 0, "  ").when(F.col("id") % 89 == 0, None).otherwise(F.col("content"))
    return t.thoughts.select("id", content.alias("content")).where("content IS NULL OR trim(content) = ''").select("id")


@query("SELECT id, CAST(length(content) AS BIGINT) AS chars FROM thoughts WHERE length(content) > 5000")
def p33_lint_long(t: Tables) -> DataFrame:
    return t.thoughts.select("id", F.length("content").cast("bigint").alias("chars")).where("chars > 5000")


@query("SELECT id FROM thoughts WHERE importance <= 30 AND length(content) < 120")
def p34_lint_low_signal(t: Tables) -> DataFrame:
    return t.thoughts.where((F.col("importance") <= 30) & (F.length("content") < 120)).select("id")


@query("SELECT id, quality_score FROM thoughts WHERE quality_score <= 29 ORDER BY quality_score, id LIMIT 50")
def p35_audit_queue(t: Tables) -> DataFrame:
    return t.thoughts.where("quality_score <= 29").orderBy("quality_score", "id").limit(50).select("id", "quality_score")


@query("SELECT id, status, importance FROM thoughts WHERE type IN ('task', 'idea') AND status IN ('new', 'planning', 'active', 'review') ORDER BY importance DESC, id")
def p36_kanban(t: Tables) -> DataFrame:
    return t.thoughts.where(F.col("type").isin("task", "idea") & F.col("status").isin("new", "planning", "active", "review")).orderBy(F.desc("importance"), "id").select("id", "status", "importance")


@query("SELECT id FROM metadata_thoughts WHERE json_extract_string(metadata, '$.status') IS NULL")
def p37_missing_metadata(t: Tables) -> DataFrame:
    return t.metadata_thoughts.where(F.get_json_object("metadata", "$.status").isNull()).select("id")


@query("""SELECT task_id, log_id, line FROM (SELECT *, CASE WHEN line = 1 THEN NULL ELSE completed_on END AS valid_from, CASE WHEN line % 4 = 0 THEN NULL ELSE completed_on + 400 END AS valid_until FROM task_logs)
WHERE (valid_from IS NULL OR valid_from <= DATE '1999-01-01') AND (valid_until IS NULL OR valid_until > DATE '1999-01-01')""")
def p38_valid_at(t: Tables) -> DataFrame:
    rows = t.task_logs.selectExpr("*", "IF(line = 1, NULL, completed_on) AS valid_from", "IF(line % 4 = 0, NULL, date_add(completed_on, 400)) AS valid_until")
    return rows.where(P.valid_at(F.col("valid_from"), F.col("valid_until"), F.to_date(F.lit("1999-01-01")))).select("task_id", "log_id", "line")


@query("SELECT memory_id FROM agent_memories WHERE workspace_id = 'w0' AND review_status = 'confirmed' AND lifecycle_status = 'active' AND memory_type LIKE 'i%' ORDER BY created_at DESC, memory_id DESC LIMIT 50")
def p39_list_memories(t: Tables) -> DataFrame:
    rows = t.agent_memories.where((F.col("workspace_id") == "w0") & (F.col("review_status") == "confirmed") & (F.col("lifecycle_status") == "active") & F.col("memory_type").startswith("i"))
    return P.newest(rows, 50, key="memory_id").select("memory_id")


@query("SELECT memory_id, workspace_id FROM agent_memories WHERE review_status = 'pending' ORDER BY created_at DESC, memory_id DESC LIMIT 100")
def p40_review_queue(t: Tables) -> DataFrame:
    return P.newest(t.agent_memories.where("review_status = 'pending'"), 100, key="memory_id").select("memory_id", "workspace_id")


@query("SELECT id FROM metadata_thoughts WHERE json_extract_string(metadata, '$.source') = 'src2' ORDER BY created_at DESC, id DESC")
def p41_by_session(t: Tables) -> DataFrame:
    return t.metadata_thoughts.where(F.get_json_object("metadata", "$.source") == "src2").orderBy(F.desc("created_at"), F.desc("id")).select("id")

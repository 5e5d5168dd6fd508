"""Writes of captures, queues, limits and model steps, against plain loops where there is an order."""

import random

from pyspark.sql import functions as F

from engram.operators import capture as C
from engram.operators import models as M
from engram.operators.chunks import contexts
from engram.operators.graph import provenance_tree
from engram.operators.windows import rate_limit

STORED = "fingerprint string, content string, metadata map<string,string>, type string, source_type string, importance long, quality_score double, sensitivity_tier string, status string, status_updated_at long"
QUEUE = "id long, status string, attempts int, last_error string, fp string, queued_at long"


def test_statuses_of_writes_against_a_loop(spark):
    r = random.Random(2)
    writes = [(k, f"text {r.randrange(12)}", {"type": r.choice(["lesson", "task"]), "importance": r.choice(["7.5", "200", "x", "-1"])}, r.choice([None, None, "done", "new", ""]), 100 + k) for k in range(200)] + [(999, None, {}, None, 1)]
    seen = {}
    for _, text, meta, status, at in writes[:-1]:
        said = status or ("new" if meta["type"] == "task" else None)
        if text not in seen:
            seen[text] = (said, at)
        else:
            was, when = seen[text]
            seen[text] = (said or was, at if said != was else when)
    rows = spark.createDataFrame(writes, "seq long, content string, metadata map<string,string>, status string, at long")
    got = C.enhanced_upsert(spark.createDataFrame([], STORED), rows).collect()
    assert {x.content: (x.status, x.status_updated_at) for x in got} == seen
    last = {w[1]: w[2] for w in writes[:-1]}
    assert all(x.importance == {"7.5": 8, "200": 100, "x": 50, "-1": 50}[last[x.content]["importance"]] and x.type == last[x.content]["type"] for x in got)


def test_limits_against_a_loop(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", None]), float(r.randrange(900))) for k in range(400)] + [(1000, "a", None)]
    df = spark.createDataFrame(rows, "n long, who string, at double").withColumn("at", F.col("at").cast("timestamp"))
    taken, want = {}, {}
    for n, who, at in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[0])):
        recent = [t for t in taken.get(who, []) if t >= at - 60]
        want[n] = len(recent) < 5
        taken[who] = recent + [at] if want[n] else recent
    got = {x.n: x.ok for x in rate_limit(df, "who", "at", "n", 5, 60).collect()}
    assert got == want and 50 < sum(want.values()) < 350
    assert rate_limit(df.limit(0), "who", "at", "n").count() == 0


def test_queue_items_are_claimed_and_settled(spark):
    queue = spark.createDataFrame([(1, "complete", 3, "e", "old", 1), (2, "complete", 3, "e", "same", 2), (3, "pending", 4, None, None, 3)], QUEUE)
    news = spark.createDataFrame([(1, "new", None, 9), (2, "same", None, 9), (4, "x", "digest", 9), (5, None, None, 9)], "id long, fp string, generated_by string, at long")
    after = C.enqueued(queue, news)
    assert {x.id: (x.status, x.attempts, x.fp, x.queued_at) for x in after.collect()} == {1: ("pending", 0, "new", 9), 2: ("complete", 3, "same", 2), 3: ("pending", 4, None, 3), 5: ("pending", 0, None, 9)}
    mine = C.claimed(after, 2, "w")
    assert {x.id for x in mine.where("worker = 'w'").collect()} == {1, 3}
    outcomes = spark.createDataFrame([(1, "release", None), (3, "error", "bad"), (5, "complete", None)], "id long, outcome string, error string")
    got = {x.id: (x.status, x.attempts, x.last_error, x.worker) for x in C.settled(mine, outcomes).collect()}
    assert got == {1: ("pending", 0, None, None), 2: ("complete", 3, "e", None), 3: ("failed", 5, "bad", "w"), 5: ("pending", 0, None, None)}


def test_second_answers_cost_confidence(spark):
    asked = []

    def provider(texts):
        asked.extend(texts)
        return [{"type": "task" if len(asked) == len(texts) else "lesson", "confidence": 8} for _ in texts]

    rows = spark.createDataFrame([(1, "a")], "id long, text string").coalesce(1)
    got = M.classified_captures(rows, "text", provider, spark.createDataFrame([], "type string, threshold double")).first()
    assert (got.type, got.confidence, got.auto) in {("task", 5.0, False), ("task", 8.0, True)}  # the second asking may be another worker's first
    odd = M.classified_captures(rows, "text", lambda texts: [{"type": "riddle", "confidence": float("nan")} for _ in texts], spark.createDataFrame([("idea", 0.7)], "type string, threshold double")).first()
    assert (odd.type, odd.confidence, odd.threshold, odd.auto) == ("idea", 7.0, 0.7, True)


def test_grades_need_three_numbers(spark):
    answers = {1: '{"existence":5,"relevance":4,"sufficiency":3}', 2: 'Well {x}. {"existence":1,"relevance":1,"sufficiency":1,"rationale":"r"} ok', 3: '{"existence":6,"relevance":1,"sufficiency":1}', 4: "no", 5: None}
    rows = spark.createDataFrame([(k, f"answer{k}", "t", "s", [0]) for k in answers] + [(0, "root", None, None, None), (9, "lost", "t", "s", [77])], "id long, content string, type string, source_type string, derived_from array<long>")
    provider = lambda texts: [{"raw": next((a for k, a in answers.items() if f"answer{k}" in x), None)} for x in texts]
    got = {x.id: (x.existence, x.rationale, x.composite) for x in M.graded_chains(rows, provider).collect()}
    assert got == {1: (5.0, "", 4.0), 2: (1.0, "r", 1.0), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def test_first_provider_that_answers(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, ""), (4, None)], "id long, text string")
    some = lambda word: lambda texts: [{"type": "task", "summary": word} if x == word else {} for x in texts]
    got = {x.id: (x.summary, x.type, x.enrichment_status) for x in M.extracted_metadata(rows, "text", [some("one"), lambda texts: [{"type": "lesson", "summary": "late"} for _ in texts]]).collect()}
    assert got == {1: ("one", "task", "complete"), 2: ("late", "lesson", "complete"), 3: ("", "idea", "fallback"), 4: (None, "idea", "fallback")}


def test_contexts_of_small_exports(spark):
    rows = spark.createDataFrame([(1, k, float(k * 20000), "user", "x" * 50) for k in range(4)] + [(2, 0, None, "user", "hi"), (3, 0, 1.0, "system", "no")], "conv long, n long, at double, role string, text string").withColumn("at", F.col("at").cast("timestamp"))
    count = lambda **kw: {(x.conv, x.place): len(x.context) for x in contexts(rows, "conv", "n", "at", most=100, head=60, tail=20, **kw).collect()}
    assert count() == {(1, k): 56 for k in range(4)} | {(2, 0): 8} and count(total=3) == {(1, 0): 60 + 20 + len("\n\n[... truncated ...]\n\n"), (2, 0): 8}


def test_trees_keep_ways_and_cycles(spark):
    rows = spark.createDataFrame([(1, [2, 3]), (2, [3]), (3, [1]), (4, None)], "id long, derived_from array<long>").selectExpr("*", "'t' AS content", "IF(id = 3, 'restricted', NULL) AS sensitivity_tier")
    got = {x.path: (x.under, x.cycle, x.parents, x.preview) for x in provenance_tree(rows, 1).collect()}
    assert got == {"1": (None, False, 2, "t"), "1/2": ("1", False, 1, "t"), "1/3": ("1", False, 1, None), "1/2/3": ("1/2", False, 1, None), "1/3/1": ("1/3", True, 0, None), "1/2/3/1": ("1/2/3", True, 0, None)}
    short = provenance_tree(rows, 1, cap=2).collect()
    assert [(x.path, x.nodes, x.truncated) for x in sorted(short, key=lambda x: x.path)] == [("1", 2, True), ("1/2", 2, True)] and provenance_tree(rows, 99).count() == 0


def test_mails_become_atoms(spark):
    rows = spark.createDataFrame([(1, "[Email a] one\ntwo"), (2, "[Email b] single"), (3, "one\ntwo"), (4, None)], "id long, content string")
    edges = spark.createDataFrame([(1, 2, "replies_to"), (2, 1, "replies_to"), (1, 3, "uses"), (2, 3, "uses")], "from_id long, to_id long, relation string")
    links = spark.createDataFrame([(1, 7), (2, 8)], "thought_id long, entity_id long")
    a, b, c = C.reatomised(rows, edges, links, F.split("body", "\n"), F.col("id") * 100 + F.col("place"), 1)
    assert {x.id: (x.content, x.re_atomized_from) for x in a.collect()} == {100: ("[Email a | atom 1 of 2] one", 1), 101: ("[Email a | atom 2 of 2] two", 1), 2: ("[Email b] single", None), 3: ("one\ntwo", None), 4: (None, None)}
    assert {tuple(x) for x in b.collect()} == {(100, 2, "replies_to"), (2, 100, "replies_to"), (2, 3, "uses")} and {tuple(x) for x in c.collect()} == {(100, 7), (101, 7), (2, 8)}

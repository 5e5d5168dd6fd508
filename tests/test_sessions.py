"""Sessions layer by layer, and provenance from artifacts."""

from pyspark.sql import functions as F

from engram.operators.provenance import provenance_backfill
from engram.operators.sessions import ENTRY, save_layers, start_sessions

SESSIONS = "session_id long, user_id long, version long, status string, current_layer string, completed_layers array<string>, created_at long"


def test_sessions_start_once(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    profiles = spark.createDataFrame([(1, "active", 4), (2, "active", 2)], "user_id long, status string, current_version long")
    sessions = spark.createDataFrame([(10, 1, 3, "in_progress", None, ["operating_rhythms"], 1), (11, 1, 4, "review_ready", "friction", [], 2), (12, 2, 9, "completed", None, [], 3)], SESSIONS)
    marks = [(11, 1, "friction", 4, "approved", "f4", None), (11, 1, "dependencies", 4, "approved", "d4", 5), (10, 1, "friction", 4, "approved", "f4b", 1), (10, 1, "friction", 9, "draft", "no", 9)]
    checkpoints = spark.createDataFrame(marks, "session_id long, user_id long, layer string, version long, status string, summary string, approved_at long")
    got = {r.user_id: r for r in start_sessions(profiles, sessions, checkpoints, users).collect()}
    assert (got[1].session_id, got[1].session_version, got[1].pending_layer, got[1].profile_status) == (11, 4, "friction", "active")
    assert [(x.layer, x.summary) for x in got[1].session_checkpoints] == [("dependencies", "d4"), ("friction", "f4")]
    assert [x.summary for x in got[1].latest_checkpoints] == ["d4", "f4b"]
    assert (got[2].session_id, got[2].session_version, got[2].session_status, got[2].profile_status) == (None, 3, "in_progress", "draft")
    assert (got[3].session_version, got[3].pending_layer, got[3].current_version) == (1, "operating_rhythms", 0)


def test_layers_are_replaced(spark):
    four = ["operating_rhythms", "recurring_decisions", "dependencies", "institutional_knowledge"]
    sessions = spark.createDataFrame([(1, "in_progress", four), (2, "completed", None), (3, "review_ready", None)], "session_id long, status string, completed_layers array<string>")
    stored = spark.createDataFrame([(1, "friction", 1), (1, "dependencies", 1), (2, "friction", 1)], "session_id long, layer string, place long").selectExpr("*", *[f"CAST(NULL AS {x.split(' ')[1]}) AS {x.split(' ')[0]}" for x in ENTRY.split(", ")])
    saves = [(1, "friction", '[{"title": " a ", "cadence": " ", "details": {"x": 1}, "inputs": ["i"]}, {"title": "b", "status": "old"}]', 2), (1, "friction", "[]", 1), (2, "friction", "[]", 1), (3, "friction", "{}", 1), (3, "dependencies", None, 1), (4, "friction", "[]", 1), (3, None, "[]", 1)]
    results, after, entries = save_layers(sessions, stored, spark.createDataFrame(saves, "session_id long, layer string, payload string, seq int"))
    assert {(r.session_id, r.layer): r.result for r in results.collect()} == {(1, "friction"): "saved", (2, "friction"): "session is not editable", (3, "friction"): "entries are no array", (3, "dependencies"): "saved", (4, "friction"): "session not found", (3, None): "invalid layer"}
    assert {r.session_id: (r.status, r.completed_layers) for r in after.collect()} == {1: ("review_ready", [*four, "friction"]), 2: ("completed", None), 3: ("in_progress", ["dependencies"])}
    rows = {(r.session_id, r.layer, r.place): r for r in entries.collect()}
    assert rows.keys() == {(1, "friction", 1), (1, "friction", 2), (1, "dependencies", 1), (2, "friction", 1)}
    a, b = rows[1, "friction", 1], rows[1, "friction", 2]
    assert (a.title, a.cadence, a.details, a.inputs, a.status) == ("a", None, '{"x":1}', ["i"], "active") and (b.title, b.details, b.inputs, b.status) == ("b", "{}", [], "old")


def test_parents_from_artifacts(spark):
    one = "123E4567-e89b-12d3-a456-426614174000"
    thoughts = spark.createDataFrame([(1, "x_report", None, "a"), (2, "x_report", "derived", "a"), (3, "note", None, "a"), (4, "wiki", None, "b"), (5, "wiki", None, "c"), (6, "wiki", None, None), (7, None, None, "a"), (8, "wiki", None, "d")], "id long, source_type string, derivation_layer string, artifact_path string").withColumn("derived_from", F.array(F.lit("old")))
    files = spark.createDataFrame([("a", f"see {one} and {one.lower()}"), ("b", f"{one} #12"), ("d", None)], "path string, text string")
    got = {r.id: (r.derivation_layer, r.derived_from, r.reason) for r in provenance_backfill(thoughts, files, ["_report", "wiki"]).collect()}
    assert got[1] == ("derived", [one.lower()], "parsed 1 parent ids") and got[2] == ("derived", ["old"], None) and got[3] == got[7] == (None, ["old"], None)
    assert [got[k][2] for k in (4, 5, 6, 8)] == ["parse error: references by number", "artifact not found", "no artifact path", "artifact has no parent ids"]
    assert provenance_backfill(thoughts, files, ["_report"], force=True).where("id = 2").first().derived_from == [one.lower()]

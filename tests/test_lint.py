import datetime as dt
import json

from pyspark.sql import functions as F

from engram.operators.lint import CATEGORIES, lint_batches, lint_findings
from engram.operators.models import atoms

AT = dt.datetime(2024, 5, 6)
KIND = "id long, content string, type string, importance int, created_at timestamp_ntz, topics array<string>"


def test_batches_hold_each_thought_once(spark):
    asked = []

    def echo(prompts):
        return [{"raw": json.dumps([len(json.loads(p.split("THOUGHTS:\n", 1)[1])), p.split("THOUGHTS:\n", 1)[1]])} for p in prompts]

    rows = [(i, f"a thought with number {i} " + "long " * (200 * (i % 3)), "idea", i, AT, ["a"] * (i % 8) if i % 2 else None) for i in range(1, 206)] + [(900, "short", "idea", 1, AT, None), (901, None, "idea", 1, AT, None), (902, " " * 40, "idea", 1, AT, None)]
    thoughts = spark.createDataFrame(rows, KIND).repartition(7)
    got = sorted(lint_batches(thoughts, echo).collect(), key=lambda r: r.batch)
    assert [i for r in got for i in r.thought_ids] == list(range(205, 0, -1))
    for r in got:
        n, text = json.loads(r.raw)
        asked += [x["id"] for x in json.loads(text)]
        assert n == len(r.thought_ids) and all(len(x["content"]) <= 400 and len(x["topics"]) <= 5 and x["date"] == "2024-05-06" for x in json.loads(text))
    assert [len(r.thought_ids) for r in got] == [20] * 10 + [5] and asked == list(range(205, 0, -1))
    assert [r.thought_ids for r in lint_batches(thoughts, echo, F.col("id") < 4, batch=2).orderBy("batch").collect()] == [[3, 2], [1]]
    assert lint_batches(thoughts.limit(0), echo).count() == 0


def test_findings_are_validated(spark):
    one = lambda **x: {"thought_ids": [1], "issue": "why", "suggested_action": "do"} | x
    answers = [
        json.dumps({c: [one()] for c in CATEGORIES} | {"invented": [one()]}),
        "```json\n" + json.dumps({"orphans": [one(thought_ids=["2", 2, 99, "x", None]), one(thought_ids=[99]), one(thought_ids=[]), one(issue=" "), one(issue=None), one(suggested_action=None)]}) + "\n```",
        json.dumps({"orphans": "none", "low_signal": [one(issue="kept")], "superseded": None, "stale_facts": {}}),
        '{"orphans": [{"thought_ids": [1]', "no", "[]", None, "", "{}",
    ]
    rows = spark.createDataFrame([(i, [1, 2], a) for i, a in enumerate(answers)], "batch long, thought_ids array<bigint>, raw string")
    got = {}
    for r in lint_findings(rows).collect():
        got.setdefault(r.batch, []).append((r.category, r.thought_ids, r.issue, r.suggested_action))
    assert sorted(got[0]) == sorted((c, [1], "why", "do") for c in CATEGORIES)
    assert sorted(got[1], key=str) == sorted([("orphans", [2], "why", "do"), ("orphans", [1], "why", None)], key=str)
    assert got[2] == [("low_signal", [1], "kept", "do")]
    assert {i: [x[0] for x in v] for i, v in got.items() if i > 2} == {i: ["unreadable"] for i in range(3, 8)}


def test_atoms_by_a_provider(spark):
    def split(texts):
        if any("fail" in t for t in texts):
            raise TimeoutError
        return [{"atoms": [" one ", "", "two"]} if "good" in t else {"atoms": ["  "]} if "blank" in t else {} for t in texts]

    long = "This is a {} sentence. Here comes another one. And then a third one."
    rows = [(1, long.format("good")), (2, long.format("blank")), (3, long.format("silent")), (4, "Only one good thought"), (5, None), (6, "")]
    found = lambda df: sorted((r.id, r.place, r.atom) for r in df.collect())
    by_rule = lambda i, w: [(i, k, x) for k, x in enumerate([f"This is a {w} sentence.", "Here comes another one.", "And then a third one."])]
    texts = spark.createDataFrame(rows, "id long, text string")
    rest = [*by_rule(2, "blank"), *by_rule(3, "silent"), (4, 0, "Only one good thought"), (6, 0, "")]
    assert found(atoms(texts, "id", "text", split)) == [(1, 0, "one"), (1, 1, "two"), *rest]
    assert found(atoms(texts, "id", "text", split, least=3)) == found(atoms(texts, "id", "text")) == [*by_rule(1, "good"), *rest]
    failing = spark.createDataFrame([(1, long.format("fail"))], "id long, text string")
    assert found(atoms(failing, "id", "text", split)) == by_rule(1, "fail")

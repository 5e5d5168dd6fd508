import json
import random

from engram.llm.chat import link_tool_calls

SCHEMAS = {"f": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "o": {"type": "object"}}, "required": ["q"], "additionalProperties": False}}
COLUMNS = "conv_id long, turn long, role string, content string, call_id string, call_name string, call_args string, result_of string, needs array<string>, call_turn string"


def linked(spark, rows, **kw):
    return {(r.conv_id, r.turn): r for r in link_tool_calls(spark.createDataFrame(rows, COLUMNS), SCHEMAS, **kw).collect()}


def test_links_depths_and_errors(spark):
    call = lambda c, t, i, args, name="f", needs=None: (c, t, "assistant", None, i, name, args, None, needs, "x")
    result = lambda c, t, of: (c, t, "tool", "done", None, None, None, of, None, "x")
    got = linked(spark, [
        (1, 0, "user", "go é \"q\"", None, None, None, None, None, "x"), call(1, 1, "a", '{"q": "x", "n": 2}'), result(1, 2, "a"), call(1, 3, "b", '{"n": 2.5, "z": 1}', needs=["a"]), result(1, 4, "b"), result(1, 5, "none"),
        call(2, 0, "a", "not json"), call(2, 1, "c", '{"q": "x"}', name="g"), call(2, 2, "d", '{"q": 1, "o": {"b": 1, "a": [1, null]}}', needs=["e"]), result(2, 3, "d"), call(2, 4, "e", '{"q": "x"}', needs=["d"]), result(2, 5, "e"),
        (None, 1, "assistant", None, "a", "f", "{}", None, None, "x"), (3, 0, None, None, None, None, None, None, None, None), call(4, 0, "k", '{"q": "' + "long " * 50_000 + '"}'),
    ])
    assert [got[1, t].link for t in range(6)] == ["none", "answered", "linked", "answered", "linked", "orphan"]
    assert [got[1, t].depth for t in range(6)] == [0, 0, 1, 2, 3, 0]
    assert got[1, 1].valid and got[1, 3].errors == ["missing q", "type of n", "unknown z"]
    assert got[2, 0].errors == ["not an object"] and got[2, 1].errors == ["no schema of g"] and got[2, 2].errors == ["type of q"]
    assert [got[2, t].depth for t in (2, 3, 4, 5)] == [None] * 4 and got[2, 0].link == "unanswered"
    assert got[1, 1].message_json == '{"role":"assistant","tool_call":{"arguments":"{\\"n\\":2,\\"q\\":\\"x\\"}","id":"a","name":"f"}}'
    assert json.loads(json.loads(got[2, 2].message_json)["tool_call"]["arguments"]) == {"o": {"a": [1, None], "b": 1}, "q": 1}
    assert got[3, 0].message_json == "{}" and got[None, 1].link == "unanswered" and len(got[4, 0].message_json) > 250_000


def test_repeats_long_chains_and_empty_tables(spark):
    rows = [(1, t, "assistant", None, f"c{t}", "f", '{"q": ""}', f"c{t - 1}" if t else None, None, None) for t in range(6)] + [(1, 3, "tool", None, None, None, None, "c0", None, None)] * 2
    df = spark.createDataFrame(rows, COLUMNS)
    assert link_tool_calls(df, SCHEMAS).count() == len(rows)
    assert link_tool_calls(df.limit(0), SCHEMAS).count() == 0


def test_deep_and_joined_chains(spark):
    """A conversation of a long chain, and one of calls that need several results, against depths found one by one."""
    r, n = random.Random(4), 1500
    rows = [(1, t, "assistant", None, f"c{t}", "f", "{}", f"c{t - 1}" if t else None, None, None) for t in range(n)]
    before = {}
    for t in range(0, 200, 2):
        needs = r.sample(range(0, t, 2), min(t // 2, r.choice([0, 1, 1, 2, 3])))
        rows += [(2, t, "assistant", None, f"c{t}", "f", "{}", None, [f"c{x}" for x in needs], None), (2, t + 1, "tool", None, None, None, None, f"c{t}", None, None)]
        before[t], before[t + 1] = [x + 1 for x in needs], [t]
    depth = {}
    for t in sorted(before):
        depth[t] = max((depth[x] + 1 for x in before[t]), default=0)
    rows += [(2, 300, "assistant", None, "p", "f", "{}", "q", ["c0"], None), (2, 301, "assistant", None, "q", "f", "{}", "p", None, None), (2, 302, "tool", None, None, None, None, "q", None, None)]
    got = linked(spark, rows)
    assert [got[1, t].depth for t in range(n)] == list(range(n))
    assert {t: got[2, t].depth for t in before} == depth and max(depth.values()) > 5
    assert [got[2, t].depth for t in (300, 301, 302)] == [None] * 3


def test_messages_without_identifiers_are_not_joined(spark):
    rows = [(1, t, "user", "hello", None, None, None, None, None, None) for t in range(2000)]
    got = link_tool_calls(spark.createDataFrame(rows, COLUMNS), SCHEMAS)
    assert {(r.link, r.depth, r.valid) for r in got.collect()} == {("none", 0, None)}

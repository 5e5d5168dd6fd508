"""Work that grows no faster than the input."""

import random
import time

from engram.operators.search import trigram_search, trigrams
from engram.plans import all_queries

QUERIES, SF = all_queries()[0], "/root/testdata/sf0.001"


def test_trigrams_of_a_long_text_take_one_pass(spark):
    r = random.Random(3)
    texts = ["", "a", "aB", "abc", None, "a\nb\r\nc", "Straße 😀😃x 😀😃y", "".join(r.choice("abé😀 ") for _ in range(500))]
    of = lambda s: None if s is None else list(dict.fromkeys(s.lower()[k : k + 3] for k in range(max(1, len(s.lower()) - 2))))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    assert [x.t for x in rows.select(trigrams(rows.content).alias("t")).collect()] == [of(s) for s in texts]
    long = spark.createDataFrame([(1, "no " * 200_000 + "yes"), (2, "no " * 200_000)], "id long, content string")
    began = time.time()
    assert [x.id for x in trigram_search(long.withColumn("trigrams", trigrams(long.content)), "O YES").collect()] == [1]
    assert time.time() - began < 30


def test_what_a_stream_gives_is_in_files(spark):
    """Not in a table in the driver's memory."""
    assert all(QUERIES[q](spark, SF).inputFiles() for q in ("r02_stream_dedup", "r08_stream_limit", "r10_stream_windows"))


def test_similar_sets_go_to_a_place_once_and_not_to_each_pair(spark):
    """A group of near copies in which all meet all, beside a set that many smaller ids are met with; by brute force, over several blocks and sizes."""
    from engram.operators.similar import _compared, similar_classes

    r = random.Random(5)
    base = [f"www{k}" for k in range(60)]
    texts = [" ".join(r.sample(base, 60 - r.randrange(8))) for _ in range(60)] + [" ".join(f"xxx{r.randrange(40)}" for _ in range(40)) for _ in range(40)]
    texts += [" ".join(f"lll{k}" for k in range(900) if r.random() > cut) for cut in (0.02, 0.03, 0.2)] + ["", "one two", "two one", None]
    sets = [set(x.split()) if x else set() for x in texts]
    expected = {(a, b): len(s & t) / len(s | t) for a, s in enumerate(sets) for b, t in enumerate(sets[a + 1 :], a + 1) if s and t and s not in sets[:a] and t not in sets[:b] and len(s & t) / len(s | t) >= 0.85}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    links = similar_classes(rows)
    assert {(x.a, x.b): x.similarity for x in links.collect()} == expected and len(expected) > 100
    codes = spark.createDataFrame([(k, [hash(w) for w in sorted(s, key=hash)]) for k, s in enumerate(sets)], "id long, tokens array<long>")
    compared = _compared(spark.createDataFrame(list(expected), "a long, b long"), codes, 0.85, block=7)
    assert {(x.a, x.b): x.similarity for x in compared.collect()} == expected
    assert "array_intersect" not in links._jdf.queryExecution().toString()


def test_tasks_of_pairs_grow_in_number_with_the_pairs(spark):
    from engram.operators.joins import shared_pairs

    links = [(i, g) for g in range(20) for i in range(g, g + 30)]
    pairs = shared_pairs(spark.createDataFrame(links, "i long, g long"), 2, "i", "g", per_task=500)
    groups = {i: {g for x, g in links if x == i} for i, _ in links}
    expected = {(a, b, len(s & groups[b])) for a, s in groups.items() for b in groups if a < b and len(s & groups[b]) >= 2}
    assert {tuple(x) for x in pairs.collect()} == expected and pairs.rdd.getNumPartitions() == 18


def test_python_gets_rows_by_their_bytes(spark):
    """Ten texts of a megabyte are no batch of their own, whatever the session has; workbooks are read some at a time."""
    import pandas as pd

    from engram.operators.batches import few
    from engram.operators.models import answered

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    texts = spark.range(12, numPartitions=1).selectExpr("id", "repeat('x', 1000000) AS text")
    sizes = [x.n for x in answered(texts, "text", lambda asked: [{"n": len(asked)}] * len(asked), "n long").select("answer.n").collect()]
    assert len(sizes) == 12 and max(sizes) <= 5
    parts = list(few(iter([pd.DataFrame({"a": range(7)}), pd.DataFrame({"a": []}), pd.DataFrame({"a": [9]})]), 3))
    assert [list(p["a"]) for p in parts] == [[0, 1, 2], [3, 4, 5], [6], [9]]


def test_files_of_chats_are_parsed_once(spark):
    """The joins of the branch read the nodes' columns, not the files."""
    df = QUERIES["s07_chat_export"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() and "from_json" not in plan and "jsontostructs" not in plan


def test_a_name_of_many_entities_is_joined_once(spark):
    from engram.operators.joins import fuzzy_names

    entities = spark.range(3000).selectExpr("id + 5 AS entity_id", "IF(id % 3 = 0, 'Red widget', IF(id % 3 = 1, 'blue anvil', 'hot')) AS canonical_name")
    names = spark.createDataFrame([("red widget",), ("blue",), ("shot hot",), ("none",), ("blue sky",)] * 2, "name string")
    found = fuzzy_names(names, entities)
    assert sorted(map(tuple, found.collect()), key=str) == [("blue sky", 6, "first_word"), ("blue", 6, "first_word"), ("none", None, "new"), ("red widget", 5, "equal"), ("shot hot", 7, "contained")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    ranges = [k for k, line in enumerate(plan) if "Range (0, 3000" in line]
    assert len(ranges) == 3 and all("Aggregate" in " ".join(plan[k - 3 : k]) for k in ranges)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_feed_entry_is_parsed_once(spark):
    from engram.sources.importers import blog_entries

    plan = _plan(blog_entries(spark.range(9).selectExpr("concat('<entry><title>t', id, '</title><content>', repeat('word ', id), '</content></entry>') AS value")).select("title"))
    assert plan.lower().count("from_xml") + plan.lower().count("xmltostructs") == 1


def test_parts_of_a_capture_are_found_once(spark):
    """No filter looks for them again."""
    plan = _plan(QUERIES["x16_prepared_payload"](spark, SF))
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("regexp" in line.lower() or "rlike" in line.lower() for line in filters)


def test_mails_are_split_once(spark):
    """All that follows reads which mails are split, not their texts again."""
    plan = _plan(QUERIES["k28_reatomise"](spark, SF))
    assert "[Email[^" not in plan


def test_the_first_merge_joins_nothing(spark, tmp_path):
    from engram.operators.table import KeyedTable

    table = KeyedTable(spark, str(tmp_path / "t"), "id bigint, m map<string,string>", ["id"], 4)
    assert "LocalRelation <empty>" in _plan(table.read()) and table.read().collect() == []


def test_postings_are_made_where_the_text_is(spark):
    from engram.operators.text_index import _postings_of

    rows = spark.createDataFrame([(7, ["a", "b", "a"]), (8, []), (9, ["c"]), (7, ["b"])], "id long, words array<string>").coalesce(1)
    found = _postings_of(rows)
    assert sorted((x.token, x.id, x.places) for x in found.collect()) == [("a", 7, [0, 2]), ("b", 7, [0]), ("b", 7, [1]), ("c", 9, [0])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_links_that_are_stored_are_read_once(spark):
    """Rows of a stored key and columns beside it stay as they are, nulls are equal, and repeated new keys count once."""
    from engram.operators.upsert import insert_ignore

    kind = "a long, b long, note string"
    old = [(1, 1, "x"), (1, 1, "y"), (1, None, "x"), (None, None, None), (2, 1, "x")]
    new = [(1, 1, "new"), (1, None, "new"), (None, None, "new"), (None, 1, "new"), (None, 1, "new"), (3, 3, "new")]
    got = insert_ignore(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["a", "b"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [*old, (None, 1, "new"), (3, 3, "new")]))
    plan = QUERIES["k08_links_upsert"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Sort [") == 1


def test_entities_of_a_name_meet_its_texts_in_cells(spark, monkeypatch, tmp_path):
    """Names that many entities and many texts have: files of the result stay small, and a row for each pair, by brute force, over cells of any size."""
    from engram.operators import entities as E

    types = ["tool", "topic", "person", "place"]
    names = [(k, types[k * k * 7 // 5 % 4], "Red widget" if k % 3 else "anvil") for k in range(30_011)] + [(5, "tool", "Red widget"), (None, "tool", "anvil"), (90_000, "topic", "rare")]
    entities = spark.createDataFrame(names, "entity_id long, entity_type string, canonical_name string")
    texts = spark.range(60).selectExpr("id", "concat(repeat('a ', int(id % 7)), IF(id % 2 = 0, 'red widget ', 'anvil '), IF(id = 7, 'rare', 'red widget')) AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if neither side were small
    try:
        E.text_entities(texts, entities, "id", "text").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    written = spark.read.parquet(str(tmp_path / "out"))
    red, anvil = (sum(n == x for *_, n in names) for x in ("Red widget", "anvil"))
    assert written.count() == 59 * red + 30 * anvil + 1
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.6 * written.count()

    for name, size in (("CELL_ENTITIES", 16), ("CELL_TEXTS", 5), ("RUN", 8)):
        monkeypatch.setattr(E, name, size)
    some, few = texts.where("id < 23"), entities.where("entity_id IS NULL OR entity_id < 200 OR entity_id = 90000")
    got = E.text_entities(some, few, "id", "text", per_task=100)
    expected = []
    for k in range(23):
        words = ["a"] * (k % 7) + (["anvil"] if k % 2 else ["red", "widget"]) + (["rare"] if k == 7 else ["red", "widget"])
        for e, kind, name in names:
            n = name.lower().split()
            at = [p for p in range(len(words)) if words[p : p + len(n)] == n]
            if at and (e is None or e < 200 or e == 90_000):
                expected.append((k, e, kind, 0.9, len(at), at[0]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected)) and got.rdd.getNumPartitions() == -(-len(expected) // 100)


def test_similar_sets_meet_in_blocks_by_size(spark, monkeypatch):
    """Cells of few sets in several waves have the links of one go, by brute force; a set goes to the cells of its size only, and nothing that moves stays on disk."""
    import random

    from engram.operators import similar as S

    r = random.Random(4)
    sets = []
    for k in range(400):
        old = sets[r.randrange(len(sets))] if sets and k % 2 else {f"w{r.randrange(2000)}" for _ in range(r.choice([5, 40, 200]))}
        sets.append({w for w in old if r.random() > 0.05} | {f"w{r.randrange(2000)}" for _ in range(r.randrange(3))} or {"one"})
    texts = spark.createDataFrame([(k, " ".join(sorted(s))) for k, s in enumerate(sets)], "id long, content string")
    words = [{w for w in s if len(w) >= 3} for s in sets]
    expected = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(words) for b, y in enumerate(words) if a < b and x != y and x and y and len(x & y) / len(x | y) >= 0.85}
    seen, one = [], S.cut_each
    monkeypatch.setattr(S, "cut_each", lambda parts: one(seen.append(1) or p for p in parts))
    first = {}
    for k, s in enumerate(words):
        first.setdefault(frozenset(s), k)
    classes = {k: first[frozenset(s)] for k, s in enumerate(words)}
    compared, links = S._compared, S._links
    for size in ({}, {"block": 3, "most_tokens": 200, "wave": 1}):
        seen.clear()
        monkeypatch.setattr(S, "_links", lambda *a, size=size: links(*a, per_wave=70 if size else 250_000))
        monkeypatch.setattr(S, "_compared", lambda *a, size=size: compared(*a, **size))
        got = {(x.a, x.b): x.similarity for x in S.similar_classes(texts).collect()}
        assert got == {k: v for k, v in expected.items() if classes[k[0]] == k[0] and classes[k[1]] == k[1]} and len(got) > 50
        assert len(seen) > 6 if size else len(seen) == 2  # waves of pairs, and of cells

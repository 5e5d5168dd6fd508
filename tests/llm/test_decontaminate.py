import random

import numpy as np

from engram.llm.bytetext import prefix_hash
from engram.llm.decontaminate import _leaks, _pieces, find_leaks, index_items, plain


def distance(part, text):
    """Least edits from part to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(part, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def flat(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return plain(raw, np.array([0, len(raw)]))[0].tobytes()


def edited(r, text, n):
    for _ in range(n):
        k = r.randrange(len(text))
        text = text[:k] + r.choice(["", "q", text[k] + "z"]) + text[k + 1 :]
    return text


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeghilmnorst") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(r.choice([4, 12, 20, 45, 80]))) for k in range(20)] + [(20, None), (None, "no number " * 9), (21, "ab"), (22, "")]
    docs = [prose(40) for _ in range(20)]
    for n in (0, 2, 4, 6, 8, 9, 10, 11, 14, 25):
        docs += [f"{prose(9)} {edited(r, items[k][1], n)} {prose(9)}" for k in r.sample(range(20), 6)]
    docs += [items[3][1].upper().replace(" ", " -- "), None, "", items[5][1], items[5][1] * 2]
    got = find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=9)
    got = {x.doc_id: x.leak_items for x in got.collect()}
    parts = index_items([(i, t) for i, t in items if i is not None and t], 120, 0.08)
    parts = [(parts.text[k, : parts.length[k]].tobytes(), int(parts.item[k]), int(parts.edits[k])) for k in range(len(parts.item))]
    want = {i: sorted({item for part, item, k in parts if distance(part, flat(t or "")) <= k}) for i, t in enumerate(docs)}
    assert got == want and sum(map(bool, want.values())) > 25


def test_where_and_edge_cases(spark):
    text = "Ünder the old bridge, a narrow boat was waiting for nobody in particular; it had waited since the spring of that year."
    docs = spark.createDataFrame([(1, "Intro. " + text + " End", "k", 3), (1, "Intro. " + text + " End", "k", 3), (2, "clean", None, None)], "doc_id long, text string, item string, leaks int")
    rows = find_leaks(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).orderBy("doc_id").collect()
    end = len(("Intro. " + text).encode()) - 1
    assert [r.leak_items for r in rows] == [[7], [7], []] and rows[0].leaks[0].edits == 0 and abs(rows[0].leaks[0].end - end) <= 1
    assert find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).where("size(leak_items) > 0").count() == 0
    assert find_leaks(docs.limit(0), spark.createDataFrame([(7, text)], "item_id long, text string")).count() == 0


def test_items_of_all_lengths(spark):
    """Items and budgets come from the texts alone; each is planted with all the edits that it allows."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    items, docs = [], []
    for n in range(1, 46):
        text = ""
        while len(text) < n:
            text += word() + " "
        text = text[: n - 1] + "x"
        items.append((n, text))
        k = int(0.08 * n)
        places = [round((j + 1) * n / (k + 1)) - 1 for j in range(k)] if k else []
        swapped = "".join("7" if j in places else c for j, c in enumerate(text))
        docs += [f"{word()} {text} {word()}", text.upper(), f"{word()} {word()} {swapped} {word()}", swapped]
    docs += [" ".join(word() for _ in range(20)) for _ in range(10)] + ["", None]
    got = find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {x.doc_id: x.leak_items for x in got.collect()}
    want = {i: [n for n, text in items if distance(text, (t or "").lower()) <= int(0.08 * n)] for i, t in enumerate(docs)}
    assert got == want and all(n in want[4 * (n - 1) + j] for n, _ in items for j in range(4))


def test_small_tables_and_pieces_find_the_same(spark, monkeypatch):
    """Long texts in pieces, q-grams that all items share, and blocks of parts: the same items as in one go."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    stock = " ".join(word() for _ in range(12))
    items = [(k, " ".join([stock, *(word() for _ in range(20))])) for k in range(30)]
    texts = [(1, " ".join(x for k in range(30) for x in (items[k][1], *(word() for _ in range(40))))), (2, (stock + " ") * 200 + items[3][1] + " end"), (3, " - ".join(word() for _ in range(300))), (4, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {r.doc_id: (r.leak_items, min((x.edits for x in r.leaks), default=None)) for r in find_leaks(docs, bench).collect()}
    assert want[1] == (list(range(30)), 0) and 3 in want[2][0] and want[3][0] == want[4][0] == []
    got = {r.doc_id: (r.leak_items, min((x.edits for x in r.leaks), default=None)) for r in find_leaks(docs, bench, block=25).collect()}
    assert got == want
    # in this process, where the bounds can be made small
    parts = index_items(items, 120, 0.08)
    for name, value in (("PIECE", 700), ("ENTRIES", 50), ("TRIES", 7)):
        monkeypatch.setattr(f"engram.llm.decontaminate.{name}", value)
    for ident, text in texts[:3]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        pieces = list(_pieces(data, np.array([0, len(data)]), parts.text.shape[1] + 2 * int(parts.edits.max())))
        found = [x for plain_text, at, _ in pieces for g in parts.grams for x in _leaks(plain_text, at, prefix_hash(plain_text), parts, g)]
        assert len(pieces) > 1 and (sorted({i for _, _, i, _ in found}), min((e for *_, e in found), default=None)) == want[ident]


def test_long_runs_of_other_bytes(spark, monkeypatch):
    """Pieces of a few bytes against the whole text: dashes before, within and after items, and items over several cuts."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(4 + 5 * k))) for k in range(6)]
    parts = index_items(items, 120, 0.08)
    reach = parts.text.shape[1] + 2 * int(parts.edits.max())
    for _ in range(6):
        text = ""
        for _ in range(r.randint(2, 8)):
            text += r.choice(["-" * r.randint(0, 900), word(), items[r.randrange(6)][1], items[r.randrange(6)][1].replace(" ", "." * r.randint(1, 300))]) + r.choice(["", " ", "é"])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        whole, _, where = plain(data, np.array([0, len(data)]))
        want = {(i, int(where[e - 1]), n) for g in parts.grams for _, e, i, n in _leaks(whole, np.array([0, len(whole)]), prefix_hash(whole), parts, g)}
        for size in (90, 300):
            monkeypatch.setattr("engram.llm.decontaminate.PIECE", size)
            got, place, last = set(), [], -1
            for piece, at, was in _pieces(data, np.array([0, len(data)]), reach):
                place += [(int(p), int(c)) for p, c in zip(was, piece, strict=True) if p > last]
                last = int(was[-1]) if len(was) else last
                got |= {(i, int(was[e - 1]), n) for g in parts.grams for _, e, i, n in _leaks(piece, at, prefix_hash(piece), parts, g)}
            assert place == list(zip(where.tolist(), whole.tolist(), strict=True))
            assert {i for i, _, _ in got} == {i for i, _, _ in want} and want <= got
    monkeypatch.undo()
    item = "what is the capital of the smallest country"
    text = "-" * ((1 << 22) - 60) + item + "-" * 10
    got = find_leaks(spark.createDataFrame([(1, text), (2, "." * (1 << 22) + item)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert all(r.leak_items == [5] for r in got)

import random
import re

from engram.llm.jaccard import similar_documents


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    line, texts = prose(25), []
    for _ in range(40):
        texts.append(" ".join(prose(r.randint(1, 120))))
    for n in (30, 60, 120):
        base = prose(n)
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, n // 20 + 1)):
                copy[r.randrange(len(copy))] = word()
            texts.append(("\n" if r.random() < 0.3 else " ").join(copy))
        for k in range(12):  # a chain: each like the one before
            base = base[2 + n // 30 :] + prose(2 + n // 30)
            texts.append(" ".join(base))
    texts += [" ".join(prose(8) + line + prose(r.randint(1, 8))) for _ in range(40)]
    texts += [texts[0]] * 4 + [texts[50].upper(), None, "", " \n\t", "one", "one", "One two", "one two three four five", "one two three four", "five   a", " ".join(prose(20_000))]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_crowded_shingles(spark, monkeypatch):
    monkeypatch.setattr("engram.llm.jaccard.CROWD", 3)
    monkeypatch.setattr("engram.llm.jaccard.BLOCK", 5)
    monkeypatch.setattr("engram.llm.jaccard.HOT", 3)
    monkeypatch.setattr("engram.llm.shared.HOT", 3)
    monkeypatch.setattr("engram.llm.jaccard.HELD", 200)
    rows = corpus(3)
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", 1), (5, "a b c d e f g", 2), (9, "a b  c d e f G", 3), (None, "a b c d e f g", 4), (3, None, 5)], "doc_id long, text string, n long")
    got = sorted(similar_documents(df).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(5, 3, 5), (5, 3, 5), (9, 3, 5), (None, 3, None), (3, 0, 3)], key=str)
    assert similar_documents(df.limit(0)).count() == 0

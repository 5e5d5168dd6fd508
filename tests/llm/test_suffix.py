import hashlib
import random

from engram.llm.suffix import dedup_substrings


def brute(rows, length=100):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen and seen[w] != (i, s):
                gone[s : s + length] = b"\1" * length
            seen.setdefault(w, (i, s))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, line = prose(60), prose(14)
    rows = [prose(r.randint(1, 150)) for _ in range(60)]
    rows += [prose(20) + common[r.randint(0, 30) :] + prose(20) for _ in range(30)]
    rows += [prose(30) + "\n" + line + "\n" + prose(30) for _ in range(30)]
    rows += [rows[3], rows[3], rows[70], rows[70][5:], "x" * 500, "ab" * 300, "ab" * 150 + "c" + "ab" * 200, None, "", "y" * 99, "y" * 99, "z" * 100, "z" * 100, "z" * 101]
    edited = rows[61].split()
    for _ in range(20):
        copy = list(edited)
        copy[r.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows.append(prose(9000) + common)
    r.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup_substrings(df, batches=3).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_many_spans_of_one_prefix(spark, monkeypatch):
    monkeypatch.setattr("engram.llm.suffix.MANY", 4)
    rows = texts()
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_rows_nulls_and_empty_tables(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(240))
    got = dedup_substrings(spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, None), (2, None, "doc")], "doc_id long, text string, doc string"))
    assert sorted(((r[0] is None, r[0]), r["n_bytes"], r["n_removed"]) for r in got.collect()) == [((False, 1), 240, 0), ((False, 1), 240, 0), ((False, 2), 0, 0), ((True, None), 240, 240)]
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0

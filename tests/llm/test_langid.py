import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from engram.llm.langid import CELLS, SCRIPTS, code_points, find_words, identify, long_text, pieces, train, viterbi, word_scores

EN = "the and of to in that it with for was this from have they which their would there what about people after"
DE = "der die das und nicht ein eine ist mit auf für von dem werden haben sich auch nach bei über können müssen"
EL = "και το να είναι για της από με στην που δεν την τον ένα αυτό θα στο οι"


def prose(r, words, n):
    return " ".join(r.choice(words.split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(prose(r, w, 50), k) for _ in range(40) for w, k in ((EN, "en"), (DE, "de"), (EL, "el"))] + [(None, "en"), ("abc", None)]
    return train(spark.createDataFrame(rows, "text string, lang string"))


def test_mixed_text_and_edge_cases(spark, model):
    r = random.Random(2)
    english, german = prose(r, EN, 30), prose(r, DE, 40)
    rows = [(1, english), (2, german), (3, english + " " + german), (4, prose(r, EL, 5)), (5, None), (6, ""), (7, "123 !?"), (8, "漢字"), (9, prose(r, DE, 30_000)), (1, english)]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, lid_score double")
    got = {x.doc_id: x for x in identify(df, model).collect()}
    assert [got[k].lid_lang for k in (1, 2, 3, 4, 5, 6, 7, 9)] == ["en", "de", "de", "el", "und", "und", "und", "de"]
    assert got[8].lid_lang in ("en", "de", "el") and got[5].lid_score == 0 and got[1].lid_score == 1
    spans = [(s.lang, rows[2][1][s.start : s.end]) for s in got[3].lid_spans]
    assert [k for k, _ in spans] == ["en", "de"] and abs(len(spans[0][1]) - len(english)) < 25
    assert 0 < got[3].lid_score < 1 and got[3].lang == "x"
    assert identify(df.limit(0), model).count() == 0


def test_no_labels(spark):
    empty = train(spark.createDataFrame([], "text string, lang string"))
    assert identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), empty).first().lid_lang == "und"


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    lengths = [0, 1, 5, 6, 2, 6]
    of = np.concatenate([[0], np.cumsum(lengths)])
    scores = r.normal(size=(of[-1], 3)) * 3
    path = viterbi(scores, of, 2.0)
    for a, b in itertools.pairwise(of):
        value = lambda p: sum(scores[a + k, x] for k, x in enumerate(p)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
        assert value(path[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))))


def brute(train_rows, texts, penalty=12.0):
    """(language, share, spans) of texts by plain loops: trigrams counted as strings, scripts by block, all switches tried word by word."""
    script = lambda ch: next((k for k, blocks in enumerate(SCRIPTS.values(), 1) if any(a <= ord(ch) <= b for a, b in blocks)), 0)
    words = lambda text: [m for m in re.finditer(r"[^\W\d_]+", text or "")]
    grams = lambda w: [("\1" + w.lower() + "\2")[k : k + 3] for k in range(len(w))]
    counts, kinds = {}, {}
    for text, lang in train_rows:
        if text is not None and lang is not None:
            for m in words(text):
                counts.setdefault(lang, Counter()).update(grams(m[0]))
                kinds.setdefault(lang, Counter())[script(m[0][0])] += 1
    langs = sorted(counts)
    allowed = {x: {k for k, n in kinds[x].items() if n >= max(1, 0.001 * kinds[x].total())} for x in langs}
    out = []
    for text in texts:
        value, back = None, []
        for m in words(text):
            kind = script(m[0][0])
            known = any(kind in allowed[x] for x in langs)
            score = {x: sum(math.log((counts[x][g] + 0.05) / (counts[x].total() + 0.05 * CELLS)) for g in grams(m[0])) if known else 0.0 for x in langs}
            score = {x: s - (1000 if known and kind not in allowed[x] else 0) for x, s in score.items()}
            if value is None:
                value, came = score, {x: x for x in langs}
            else:
                top = max(langs, key=lambda x: value[x])
                came = {x: x if value[x] >= value[top] - penalty else top for x in langs}
                value = {x: max(value[x], value[top] - penalty) + score[x] for x in langs}
            back.append(came)
        path = []
        if value:
            state = max(langs, key=lambda x: value[x])
            for came in reversed(back):
                path.append(state)
                state = came[state]
        path.reverse()
        letters, spans = Counter(), []
        for m, x in zip(words(text), path, strict=True):
            letters[x] += len(m[0])
            spans = [*spans[:-1], (spans[-1][0], m.end(), x)] if spans and spans[-1][2] == x else [*spans, (m.start(), m.end(), x)]
        best = min(letters, key=lambda x: (-letters[x], x)) if letters else "und"
        out.append((best, letters[best] / letters.total() if letters else 0.0, spans))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    learn = [(prose(r, w, 30), k) for _ in range(20) for w, k in ((EN, "en"), (DE, "de"), (EL, "el"))]
    texts = [" ".join(prose(r, r.choice([EN, DE, EL]), r.randint(1, 25)) for _ in range(r.randint(1, 6))) for _ in range(40)] + [None, "", "12 .", "漢字 und", "The THE der"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.lid_lang, round(x.lid_score, 9), [tuple(s) for s in x.lid_spans]) for x in identify(docs, train(spark.createDataFrame(learn, "text string, lang string"))).collect()}
    want = {k: (lang, round(share, 9), spans) for k, (lang, share, spans) in enumerate(brute(learn, texts))}
    assert got == want and len({v[0] for v in want.values()}) == 4


def test_long_texts_in_pieces(model):
    """A text of one language and one of several, with a word longer than a piece: as in one go."""
    r = random.Random(6)
    mixed = " ".join(prose(r, w, r.randint(5, 60)) for _ in range(30) for w in (EN, DE, EL)) + " " + "der" * 400 + " the end"
    bare = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(1500))
    for text in (prose(r, EN, 3000), mixed, "x" * 2000, "1 " * 1000, bare, bare[:700] + "\u3002" + bare[700:], prose(r, DE, 900).replace(" ", ","), prose(r, EL, 400).replace(" ", ""), "ab \u0301\u0301" * 400):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        w = find_words(data, np.array([0, len(data)]))
        path = viterbi(word_scores(w, model), np.array([0, len(w.text)]), 12.0)
        want, letters = [], np.zeros(3)
        for a, b, k, n in zip(w.start, w.end, path, w.letters, strict=True):
            letters[k] += n
            want = [*want[:-1], (want[-1][0], b, k)] if want and want[-1][2] == k else [*want, (a, b, k)]
        cuts = list(pieces(data, 500))
        assert sum(b - a for a, b in cuts) == len(data) and max(b - a for a, b in cuts) <= 503
        whole = [(int(s), int(e)) for s, e in zip(w.start, w.end, strict=True)]
        lead = np.cumsum([0] + [len(data[a:b].tobytes().decode()) for a, b in cuts])
        parts = [find_words(data[a:b], np.array([0, b - a])) for a, b in cuts]
        assert [(int(s + lead[k]), int(e + lead[k])) for k, p in enumerate(parts) for s, e in zip(p.start, p.end, strict=True)] == whole and all(e - s <= 64 for s, e in whole)
        weight, spans = long_text(data, model, 12.0, 500)
        assert spans == want and weight.tolist() == letters.tolist()


def test_code_points():
    texts = ["aé漢😀", "", "ß"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    chars, at = code_points(np.frombuffer(b"".join(raw), dtype=np.uint8), at)
    assert "".join(map(chr, chars)) == "".join(texts) and at.tolist() == [0, 4, 4, 5]

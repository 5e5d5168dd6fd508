import math
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm.quality import BIAS, SCALE, Learner, _sampled, features, grams_of, score, sigmoid, train
from engram.llm.queries import QUERIES

TEXTS = [
    "", " \t\n", "one", "Two words", "The THE the 12 a1b2!! x,y;; x,y;;", "żółw ŻÓŁW ß 漢字漢字 end", "a" * 700 + " b " + "C" * 513, "ABC\x0b\x0cDEF\rG 9.99$ (see http://x.y/z?q=1)", "w " * 300,
    "no break stays", "tail ", " head",
]


def raw(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def counted(text):
    """Counts of all n-grams, in both spellings, by plain string work."""
    cut = [w[k : k + 256] for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()) for k in range(0, len(w), 256)]
    kind = lambda b: "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
    shapes = ["".join(k for k, _ in groupby(map(kind, w))) for w in cut]
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in cut]
    return Counter((name, *seq[k : k + n]) for name, seq, sizes in (("word", lower, (1, 2)), ("shape", shapes, (1, 2, 3))) for n in sizes for k in range(len(seq) - n + 1))


@pytest.mark.parametrize("text", TEXTS)
def test_features_are_the_ngrams(text):
    want = counted(text)
    ids, x = features(raw(text))
    total = max(sum(want.values()), 1)
    assert ids[-1] == BIAS and x[-1] == 1.0
    assert sorted(x[:-1]) == pytest.approx(sorted(SCALE * n / total for n in want.values()))  # no two n-grams of these texts share a number


def test_equal_ngrams_have_equal_numbers():
    a, b = (set(features(raw(t))[0]) for t in ("Big dogs", "so many big DOGS"))
    assert len(a & b) == 1 + 3 + 1 + 0 + 0  # the shared one, big, dogs, big dogs; shape a


@pytest.mark.parametrize("text", [*TEXTS, "x" * 5000, "ab cd " * 2000 + "y" * 3000 + " z"])
def test_pieces_give_what_the_whole_gives(text):
    whole = np.sort(np.concatenate([*grams_of(raw(text), 1 << 20), np.zeros(0, dtype=np.int64)]))
    for limit in (256, 512, 1024):
        got = np.sort(np.concatenate([*grams_of(raw(text), limit), np.zeros(0, dtype=np.int64)]))
        assert np.array_equal(got, whole)


def test_learner_against_sums_one_by_one():
    r = np.random.default_rng(1)
    m = Learner.fresh(rate=0.5, l1=0.1, l2=0.2)
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= 0.1 else -(v - math.copysign(0.1, v)) / ((1 + math.sqrt(n[i])) / 0.5 + 0.2)

    for _ in range(200):
        ids = np.append(r.choice(50, 5, replace=False), BIAS)
        x, y = np.append(r.random(5) * 3, 1.0), int(r.random() < 0.3)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(ids, x, strict=True))))
        for i, v, w in [(i, v, weight(i)) for i, v in zip(ids, x, strict=True)]:
            g = (p - y) * v
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5
            z[i], n[i] = z.get(i, 0.0) + g - s * w, n.get(i, 0.0) + g * g
        m.learn(ids, x, y)
    got = m.weights()
    assert got[list(z)] == pytest.approx([weight(i) for i in z]) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)


def corpus(spark, n=600):
    r = random.Random(2)
    say = lambda good: " ".join(("plain" if good else "LOUD!!") if r.random() < 0.4 else f"w{r.randrange(400)}" for _ in range(r.randrange(3, 60)))
    rows = [(k, say(k % 3 > 0), int(k % 3 > 0)) for k in range(n)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, y, 0) for k, _, y in rows], "doc_id long, quality int, toxic int"), rows


def test_learns_and_does_not_depend_on_partitions(spark):
    docs, labels, rows = corpus(spark)
    seen = labels.where("doc_id < 400")
    weights = train(docs, seen, shards=3)
    assert np.allclose(weights, train(docs.repartition(7), seen.repartition(5), shards=3), atol=1e-12)
    got = {r.doc_id: r for r in score(docs, weights).collect()}
    want = {k: sigmoid(float(weights[ids] @ x)) for k, t, _ in rows for ids, x in [features(raw(t))]}
    assert {k: r.quality_score for k, r in got.items()} == pytest.approx(want)
    assert all(r.quality_predicted == (r.quality_score >= 0.7) for r in got.values())
    assert np.mean([got[k].quality_predicted == y for k, _, y in rows if k >= 400]) > 0.95
    assert np.mean([(p > 0.5) == y for k, _, y in rows if k >= 400 for p in [got[k].quality_score]]) > 0.95


def test_sample_is_bounded_and_keeps_to_one_label(spark):
    _, labels, _ = corpus(spark)
    more = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.id for r in _sampled(labels.where("doc_id > 9").unionByName(more), "doc_id", "quality", 10**6).collect()) == list(range(10, 600))
    for most in (0, 1, 50, 599, 600):
        n = _sampled(labels, "doc_id", "quality", most).count()
        assert n <= most and (most < 50 or n > 0.6 * most)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (2, "", "b", 2), (None, "some words", None, 3), (4, "x" * 600_000, "c", 4), (5, "ab " * 200_000, "c", 4)], "doc_id long, text string, quality string, quality_score int")
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 1), (2, 1, 1), (77, 0, 0)], "doc_id long, quality int, text int")
    weights = train(docs, labels)
    got = score(docs, weights).collect()
    assert len(got) == 6 and all(0 <= r.quality_score <= 1 for r in got) and {r.quality for r in got} == {"a", "b", "c", None}
    assert len({r.quality_score for r in got if r.doc_id in (1, 2)}) == 1
    by = {r.doc_id: r.quality_score for r in got}
    assert by[4] < 0.5 < by[5]
    nothing = train(docs.limit(0), labels.limit(0))
    assert not nothing.any() and score(docs.limit(0), nothing).count() == 0
    assert {r.quality_score for r in score(docs, nothing).collect()} == {0.5}


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_quality_classifier"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(F.col("held_out") & F.col("quality").isNotNull()).collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95

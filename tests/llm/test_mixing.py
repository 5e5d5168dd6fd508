import random

from engram.llm.mixing import mix_sources, source_targets


def water(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by sharing the excess again and again."""
    keys = sorted(sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    full, target, left = set(), {}, float(sum(sizes.values()))
    while True:
        open_ = [k for k in keys if k not in full]
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if left * w[k] / total > most * sizes[k] + 1e-9]
        if not over:
            return target | {k: left * w[k] / total for k in open_}
        for k in over:
            full.add(k)
            target[k] = most * sizes[k]
        left = sum(sizes.values()) - sum(target.values())


def test_targets(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 30}, {"a": 5}, {"a": 0, "b": 7}, {"x": 100, "y": 1, "z": 1}):
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size long"))
        want = water(sizes)
        assert all(abs(r.target - want[r.source_key]) < 1e-6 for r in got.collect())


def test_taken_words_are_near_the_targets(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "a", "a", "b", "c", None]), "x") for k in range(900)] + [(5, "w w", "a", "y"), (5, "w w", "a", "y"), (None, "w", "b", "z"), (901, None, "b", "z"), (902, "w " * 30_000, "b", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string").repartition(7)
    got = mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= x.mix_copies <= 3 for x in got)
    for key in ("a", "b", "c", None):
        mine = [x for x in got if x.source == key]
        target, taken = mine[0].mix_target, sum(x.mix_size * x.mix_copies for x in mine)
        assert abs(taken - target) <= max(x.mix_size for x in mine) * 2
    again = mix_sources(df.repartition(3)).collect()
    assert sorted((str(x.doc_id), x.mix_size, x.mix_copies) for x in got) == sorted((str(x.doc_id), x.mix_size, x.mix_copies) for x in again)
    assert mix_sources(df.limit(0)).count() == 0

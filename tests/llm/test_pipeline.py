import hashlib
import json
import re

import corpus_pipeline
from engram.llm.decontaminate import index_items
from engram.llm.langid import held_out, identify, train
from tests.llm.test_decontaminate import distance, flat
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def copies(docs):
    """Systematic sampling in plain Python: copies of each document."""
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    by = {}
    for d in docs:
        by.setdefault("1" if d.source is None else "0" + d.source, []).append(d)
    sizes = {k: sum(map(size, v)) for k, v in by.items()}
    from tests.llm.test_mixing import water

    target, out = water(sizes), {}
    for k, own in by.items():
        digits = lambda d: len(f"{size(d):b}")
        own.sort(key=lambda d: (digits(d) * 16 + (size(d) >> max(digits(d) - 4, 0)), h(str(d.doc_id)) % 256, size(d), d.doc_id))
        each, offset = target[k] / sizes[k] if sizes[k] else 0, h("1:" + k) / 2**32
        for place, d in enumerate(own, 1):
            out[d.doc_id] = int(offset + each * place) - int(offset + each * (place - 1))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {d.doc_id: d for d in docs.collect()}
    found = identify(docs, train(docs.where(~held_out()).select("text", "lang"))).collect()
    kept = [rows[x.doc_id] for x in found if x.lid_lang != "und" and x.lid_score >= corpus_pipeline.LEAST_SHARE]
    assert len(kept) > 0.97 * len(rows)
    first = {i for i, _, c in brute([(d.doc_id, d.text) for d in kept]) if i == c}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    parts = index_items([(x.item_id, x.text) for x in items], 120, 0.08)
    parts = [(parts.text[k, : parts.length[k]].tobytes(), int(parts.edits[k])) for k in range(len(parts.item))]
    # whole words of 12 characters that a text and a part both have decide which pairs are worth an alignment
    clean = []
    for d in kept:
        if d.doc_id in first:
            text = flat(d.text)
            near = [(p, k) for p, k in parts if any(p[j : j + 10] in text for j in range(0, len(p) - 9))]
            if all(distance(p, window(text, p, k)) > k for p, k in near):
                clean.append(d)
    want = copies(clean)
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert tuple(r[c] for c in corpus_pipeline.COLUMNS) == tuple(rows[r.doc_id][c] for c in corpus_pipeline.COLUMNS)
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def window(text, part, k):
    """The stretch of a text around the q-grams that it shares with a part."""
    at = [i for j in range(len(part) - 9) for i in [text.find(part[j : j + 10])] if i >= 0]
    return text[max(0, min(at) - len(part) - k) : max(at) + len(part) + k + 10]


def test_stages(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "a", 3, "extra"), (1, "one two three four five six", "en", "a", 3, "extra"), (2, "ONE two three  four five six", "en", None, 3, ""), (3, None, None, None, None, None), (None, "some words here", "en", "b", 1, "")], "doc_id long, text string, lang string, source string, n_chars long, lid_lang string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(str(r.doc_id) for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()) == ["1", "1", "3", "None"]
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]).count(",") == 4

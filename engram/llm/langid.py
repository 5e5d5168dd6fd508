"""Language ID: scripts narrow the candidates of each word, Viterbi over words' scores labels spans of mixed text."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.llm.bytetext import SLICE, U, mixed, slices

#: First and last code points of scripts' blocks. Other letters are of script 0.
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
CELLS = 1 << 16
PARTS = 16
START, END = 1, 2
#: Letters and marks of a word; a longer run, as in scripts without blanks, is several words.
LONG = 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: letter, letter or mark, lower case, script."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    inside = letter | np.array([k == "M" for k in kinds])
    lower = np.arange(sys.maxunicode + 1, dtype=np.int64)
    for c in np.flatnonzero(letter):
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    script = np.zeros(sys.maxunicode + 1, dtype=np.int8)
    for k, blocks in enumerate(SCRIPTS.values(), 1):
        for a, b in blocks:
            script[a : b + 1] = k
    return letter, inside, lower, script


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the texts' offsets in them."""
    lead = (data & 0xC0) != 0x80
    where = np.flatnonzero(lead)
    b = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (b[where + k] for k in range(4))
    low = lambda x: x & 0x3F
    two, three, four = (b0 & 0x1F) << 6 | low(b1), (b0 & 0x0F) << 12 | low(b1) << 6 | low(b2), (b0 & 0x07) << 18 | low(b1) << 12 | low(b2) << 6 | low(b3)
    chars = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)))
    return np.minimum(chars, sys.maxunicode), np.concatenate([[0], np.cumsum(lead)])[at]


def pieces(data: np.ndarray, limit: int):
    """(start, end) of stretches of about limit bytes of a text, cut after a character that is neither letter nor mark, so that no word is in two.

    In a run of letters without such a character the cut is at a multiple of LONG from its start, where a word ends as well.
    """
    inside, limit, start = _tables()[1], max(limit, 4 * LONG), 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end < len(data):
            chars, _ = code_points(data[start:end], np.array([0, end - start]))
            where = np.append(np.flatnonzero((data[start:end] & 0xC0) != 0x80), end - start)
            other = np.flatnonzero(~inside[chars])
            after = int(other[-1]) + 1 if len(other) else 0
            end = start + int(where[after + (len(chars) - after) // LONG * LONG])
        yield start, end
        start = end


@dataclass
class Words:
    """Runs of letters and marks with a letter in them: start, end, text, letters and script of each; cells of the trigrams around each character."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    cell_at: np.ndarray
    cells: np.ndarray


def find_words(data: np.ndarray, at: np.ndarray) -> Words:
    letter, inside, lower, script = _tables()
    chars, at = code_points(data, at)
    within = inside[chars]
    edge = np.zeros(len(chars) + 1, dtype=bool)
    edge[at] = True
    first = within & (~np.concatenate([[False], within[:-1]]) | edge[:-1]) if len(chars) else within
    last = within & (~np.concatenate([within[1:], [False]]) | edge[1:]) if len(chars) else within
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if (end - start > LONG).any():
        places = np.arange(len(chars))
        first |= within & ((places - np.maximum.accumulate(np.where(first, places, 0))) % LONG == 0)
        last = within & (np.concatenate([~within[1:] | first[1:], [True]]) | edge[1:])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    c = lower[chars]
    before = np.where(first, START, np.concatenate([[START], c[:-1]])) if len(c) else c
    after = np.where(last, END, np.concatenate([c[1:], [END]])) if len(c) else c
    inner = np.flatnonzero(within)
    with np.errstate(over="ignore"):
        h = mixed(before[inner].astype(U) * U(0x9E3779B97F4A7C15) + c[inner].astype(U) * U(0xC2B2AE3D27D4EB4F) + after[inner].astype(U) * U(0x165667B19E3779F9))
    letters = np.concatenate([[0], np.cumsum(letter[chars])])
    letters = letters[end] - letters[start]
    text = np.searchsorted(at, start, "right") - 1
    kind = script[chars[start]] if len(start) else np.zeros(0, dtype=np.int8)
    length = end - start
    return Words(start - at[text], end - at[text], text, letters, kind, np.concatenate([[0], np.cumsum(length)]), (h % U(CELLS)).astype(np.int64))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # cells x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = 0.001, smooth: float = 0.05, max_langs: int = 400) -> Model:
    """Trigram counts of all documents with a language, and the scripts that make min_share of a language's words or more.

    A task sums before it sends: for each of its languages PARTS rows. The driver gets a table of CELLS counts for each
    language; over max_langs languages raise ValueError, which bounds what is sent to it and broadcast. No labelled
    document: no languages, and all texts are und.
    """

    def counts(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            code, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
            for row, end, data, at in slices(batch.column(0)):
                for a, b in [(0, len(data))] if end - row > 1 else pieces(data, SLICE):
                    w = find_words(data[a:b], at if end - row > 1 else np.array([0, b - a]))
                    lang = code[row:end][w.text]
                    for k in np.unique(lang):
                        cells, scripts = sums.setdefault(names[k], (np.zeros(CELLS), np.zeros(len(SCRIPTS) + 1)))
                        own = np.repeat(lang == k, np.diff(w.cell_at))
                        cells += np.bincount(w.cells[own], minlength=CELLS)
                        scripts += np.bincount(w.script[lang == k], minlength=len(scripts))
        rows = []
        for name, (cells, scripts) in sums.items():
            rows += [(name, k, part.tobytes()) for k, part in enumerate(np.split(cells, PARTS))] + [(name, PARTS, scripts.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "part", "block"])

    def total(table: pa.Table) -> pa.Table:
        block = sum(np.frombuffer(b.as_buffer()) for b in table.column("block"))
        return pa.table([table.column("lang")[:1], table.column("part")[:1], pa.array([block.tobytes()], pa.binary())], ["lang", "part", "block"])

    schema = "lang string, part int, block binary"
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.mapInArrow(counts, schema).groupBy("lang", "part").applyInArrow(total, schema).limit((PARTS + 1) * max_langs + 1).collect()
    if len(rows) > (PARTS + 1) * max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted({r.lang for r in rows})
    blocks = {(r.lang, r.part): np.frombuffer(r.block) for r in rows}
    cells = np.stack([np.concatenate([blocks[x, k] for k in range(PARTS)]) for x in langs], axis=1) if langs else np.zeros((CELLS, 0))
    scripts = np.stack([blocks[x, PARTS] for x in langs], axis=1) if langs else np.zeros((len(SCRIPTS) + 1, 0))
    scores = np.log((cells + smooth) / (cells.sum(axis=0) + smooth * CELLS))
    return Model(langs, scores.astype(np.float32), scripts >= np.maximum(1, min_share * scripts.sum(axis=0)))


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Words x languages: log probabilities; a language that a word's script excludes is far below. A script that none has excludes none."""
    sums = np.zeros((len(w.cells) + 1, len(model.langs)))
    np.cumsum(model.scores[w.cells], axis=0, out=sums[1:], dtype=np.float64)
    scores = sums[w.cell_at[1:]] - sums[w.cell_at[:-1]]
    known = model.allowed.any(axis=1)
    scores[~known[w.script]] = 0
    scores[~model.allowed[w.script] & known[w.script][:, None]] -= 1000.0
    return scores


def viterbi(scores: np.ndarray, of: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word, of[i] to of[i + 1] the words of text i: the best path, each change of language costs penalty.

    Where no stretch is better by more than the penalty in another language than in the best one overall, that one is the
    path. Other texts go step by step, all at once.
    """
    n, langs = scores.shape
    lengths = np.diff(of)
    if not n:
        return np.zeros(0, dtype=np.int64)
    sums = np.concatenate([np.zeros((1, langs)), np.cumsum(scores, axis=0)])
    best = np.argmax(sums[of[1:]] - sums[of[:-1]], axis=1)
    path = np.repeat(best, lengths)
    gain = np.cumsum(scores - scores[np.arange(n), path][:, None], axis=0)
    before = np.concatenate([np.zeros((1, langs)), gain[:-1]])
    text = np.repeat(np.arange(len(lengths)), lengths)
    span = 2 * np.abs(gain).max() + 1
    low = np.minimum.accumulate(before - text[:, None] * span, axis=0) + text[:, None] * span
    hard = np.unique(text[((gain - low) > penalty).any(axis=1)])
    hard = hard[np.argsort(-lengths[hard], kind="stable")]
    if not len(hard):
        return path
    first, size = of[hard], lengths[hard]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    value = scores[first].copy()
    came = []
    for t in range(1, steps):
        k = active[t]
        v = value[:k]
        top = np.argmax(v, axis=1)
        switch = v[np.arange(k), top] - penalty
        stay = v >= switch[:, None]
        came.append(np.where(stay, np.arange(langs), top[:, None]).astype(np.int16))
        value[:k] = np.where(stay, v, switch[:, None]) + scores[first[:k] + t]
    state = np.argmax(value, axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        path[first[:k] + t] = state[:k]
        if t:
            state[:k] = came[t - 1][np.arange(k), state[:k]]
    return path


def _steps(scores: np.ndarray, value: np.ndarray | None, penalty: float, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Values of the best paths after these words, from those before them (None at the start of a text); with back, where each came from."""
    came = np.empty(scores.shape, dtype=np.int16) if back else None
    stay = np.arange(scores.shape[1])
    for t, row in enumerate(scores):
        if value is None:
            value, origin = row.copy(), stay
        else:
            top = int(np.argmax(value))
            keep = value >= value[top] - penalty
            origin = np.where(keep, stay, top)
            value = np.where(keep, value, value[top] - penalty) + row
        if back:
            came[t] = origin
    return value, came


def long_text(data: np.ndarray, model: Model, penalty: float, limit: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Letters by language, and spans (start, end, language), of one text, piece by piece: the same path as viterbi's.

    A first pass sums scores; a second sees whether the best language stays best. If not, a third keeps the values before
    each piece and a last one goes back over the pieces, whose steps it repeats from those values. No table is longer than a piece.
    """
    cuts = list(pieces(data, limit))
    lead = np.cumsum([0] + [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in cuts])

    def scored(k: int) -> tuple[Words, np.ndarray]:
        a, b = cuts[k]
        w = find_words(data[a:b], np.array([0, b - a]))
        return w, word_scores(w, model)

    total = np.zeros(len(model.langs))
    for k in range(len(cuts)):
        total += scored(k)[1].sum(axis=0)
    best = int(np.argmax(total))
    gain, low, plain = np.zeros(len(total)), np.full(len(total), np.inf), True
    for k in range(len(cuts)):
        scores = scored(k)[1]
        rise = gain + np.cumsum(scores - scores[:, best : best + 1], axis=0)
        before = np.minimum.accumulate(np.concatenate([np.minimum(low, gain)[None], rise[:-1]])) if len(rise) else rise
        if len(rise):
            plain &= not ((rise - before) > penalty).any()
            gain, low = rise[-1], before[-1]
    starts, value = [], None
    for k in range(len(cuts) if not plain else 0):
        starts.append(value)
        value, _ = _steps(scored(k)[1], value, penalty, back=False)
    weight, spans, state = np.zeros(len(total)), [], None if value is None else int(np.argmax(value))
    for k in reversed(range(len(cuts))):
        w, scores = scored(k)
        path = np.full(len(scores), best)
        if not plain:
            _, came = _steps(scores, starts[k], penalty, back=True)
            for t in range(len(scores) - 1, -1, -1):
                path[t] = state
                state = int(came[t, state])
        np.add.at(weight, path, w.letters)
        new = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, dtype=np.int64)
        last = np.append(new[1:], len(path)) - 1 if len(path) else new
        mine = [(int(w.start[a] + lead[k]), int(w.end[b] + lead[k]), int(path[a])) for a, b in zip(new, last, strict=True)]
        if mine and spans and mine[-1][2] == spans[-1][2]:
            mine[-1] = (mine[-1][0], spans.pop()[1], mine[-1][2])
        spans += reversed(mine)
    return weight, spans[::-1]


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """All rows and columns of docs with lid_lang, lid_score and lid_spans.

    lid_spans: (start, end, lang) in characters, the stretches of words of one language. lid_lang: the language with the
    most letters in them (of equal ones the first by name), und for a null text or one without letters. lid_score: its
    share of the letters, 0 for und. A word is a run of letters and marks; of a run over LONG of them each LONG are one. Nothing but the text is looked at. Texts go whole: those over the slice a piece at a
    time, with the same result. Slices are the smaller the more languages there are. Columns named lid_* are replaced.
    """
    docs = docs.drop("lid_lang", "lid_score", "lid_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    limit = max(1 << 15, min(SLICE, (1 << 22) // max(len(model.langs), 1)))

    def label(batches):
        model = shared.value
        names = pa.array([*model.langs, "und"], pa.string())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            langs, shares, spans = [], [], []
            for row, end, data, at in slices(batch.column(place), limit):
                n = end - row
                if n == 1 and len(data) > limit and model.langs:
                    one, found = long_text(data, model, penalty, limit)
                    weight = one[None]
                    spans.append(pa.array([[{"start": a, "end": b, "lang": model.langs[k]} for a, b, k in found]], kind))
                else:
                    w = find_words(data, at)
                    of = np.searchsorted(w.text, np.arange(n + 1))
                    path = viterbi(word_scores(w, model), of, penalty) if model.langs else np.zeros(0, dtype=np.int64)
                    weight = np.zeros((n, max(len(model.langs), 1)))
                    if len(path):
                        np.add.at(weight, (w.text, path), w.letters)
                    text = w.text[: len(path)]
                    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (path[1:] != path[:-1])])) if len(path) else np.zeros(0, dtype=np.int64)
                    last = np.append(new[1:], len(path)) - 1 if len(path) else new
                    parts = pa.StructArray.from_arrays([pa.array(w.start[new], pa.int64()), pa.array(w.end[last], pa.int64()), names.take(pa.array(path[new]))], ["start", "end", "lang"])
                    spans.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(n + 1)), pa.int32()), parts).cast(kind))
                total = weight.sum(axis=1)
                langs.append(np.where(total > 0, np.argmax(weight, axis=1), len(model.langs)))
                shares.append(weight.max(axis=1) / np.maximum(total, 1))
            whole = lambda x: np.concatenate(x) if x else np.zeros(0)
            found = [names.take(pa.array(whole(langs).astype(np.int64))), pa.array(whole(shares), pa.float64()), pa.concat_arrays(spans) if spans else pa.array([], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "lid_lang", "lid_score", "lid_spans"])

    schema = StructType(list(docs.schema))
    for field in StructType.fromDDL("lid_lang string, lid_score double, lid_spans array<struct<start:bigint,end:bigint,lang:string>>"):
        schema = schema.add(field)
    return docs.mapInArrow(label, schema)


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))

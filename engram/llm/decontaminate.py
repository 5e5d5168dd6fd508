"""Benchmark decontamination: regions of texts within a few edits of a part of a benchmark item.

By the q-gram lemma a region within k edits of a part of n characters shares n + 1 - q (k + 1) of its q-grams at least,
all on diagonals (place in the text less place in the part) that differ by k at most. Shared q-grams are counted in overlapping
bands of diagonals; a band with enough of them is verified by alignment within the band. q is 10, or smaller for short parts
where the lemma would promise nothing, so that each part keeps its whole budget of edits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.llm.bytetext import U, prefix_hash, slices, window_hash
from engram.llm.shared import discard, materialise

Q = 10
BITS = 22
#: Shared q-grams and candidates that are looked at at once, and bytes of one text.
ENTRIES, TRIES, PIECE = 1 << 20, 1 << 11, 1 << 22
_KEEP = np.full(256, 0x20, dtype=np.uint8)
_KEEP[0x80:] = np.arange(0x80, 0x100)
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _KEEP[ord(_a) : ord(_b) + 1] = np.arange(ord(_a), ord(_b) + 1)
_KEEP[ord("A") : ord("Z") + 1] += 32


def plain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and each run of ASCII that is no letter or digit one blank; the texts' offsets; where each byte was."""
    mapped = _KEEP[data]
    blank = mapped == 0x20
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True
    keep = ~blank | np.concatenate([[False], ~blank[:-1]]) & ~first[:-1] if len(data) else blank
    return mapped[keep], np.concatenate([[0], np.cumsum(keep)])[at], np.flatnonzero(keep)


@dataclass
class Grams:
    """The q-grams of the parts that have this q, in order of their hash with (part, place)."""

    q: int
    hashes: np.ndarray
    at: np.ndarray
    part: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


@dataclass
class Parts:
    """Parts of items: text, item, edit budget and least number of shared q-grams of each, and the q-grams by q."""

    text: np.ndarray
    length: np.ndarray
    item: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    grams: list[Grams]


def parts_of(text: str | None, size: int, rate: float) -> list[bytes]:
    """An item of up to 1.5 sizes is one part; a longer one is cut into parts of that size, half overlapping, to the end."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    raw = plain(raw, np.array([0, len(raw)]))[0].tobytes().strip()
    n = len(raw)
    starts = [0] if n <= size * 3 // 2 else [*range(0, n - size, size // 2), n - size]
    parts = [raw[s : s + (size if len(starts) > 1 else n)] for s in starts]
    return [x for x in parts if len(x) > int(rate * len(x))]


def index_items(items: list[tuple[int, str]], size: int, rate: float) -> Parts:
    return index_parts([(ident, x) for ident, text in items for x in parts_of(text, size, rate)], rate)


def index_parts(parts: list[tuple[int, bytes]], rate: float) -> Parts:
    """A part's q is Q, or the most with which the bound is 1 at least: a part under Q bytes is one q-gram, which is found as it is."""
    texts, owner = [x for _, x in parts], [ident for ident, _ in parts]
    length = np.array([len(t) for t in texts], dtype=np.int64)
    edits = (rate * length).astype(np.int64)
    width = int(length.max()) if len(texts) else 0
    table = np.zeros((len(texts), width), dtype=np.uint8)
    q = np.minimum(Q, length // (edits + 1))
    for k, t in enumerate(texts):
        table[k, : len(t)] = np.frombuffer(t, dtype=np.uint8)
    grams = [_grams(table, length, np.flatnonzero(q == size), int(size)) for size in np.unique(q)]
    return Parts(table, length, np.array(owner, dtype=np.int64), edits, length + 1 - q * (edits + 1), grams)


def _grams(table: np.ndarray, length: np.ndarray, parts: np.ndarray, q: int) -> Grams:
    hashes, part, place = [], [], []
    for k in parts:
        h = window_hash(prefix_hash(table[k, : length[k]]), q)
        hashes.append(h)
        part.append(np.full(len(h), k))
        place.append(np.arange(len(h)))
    hashes, part, place = np.concatenate(hashes), np.concatenate(part), np.concatenate(place)
    order = np.argsort(hashes, kind="stable")
    distinct, first = np.unique(hashes[order], return_index=True)
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[(distinct >> U(64 - BITS)).astype(np.int64)] = True
    return Grams(q, distinct, np.append(first, len(hashes)), part[order], place[order], bitmap)


def candidates(prefix: np.ndarray, parts: Parts, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(part, lowest diagonal of a band) of the bands with enough shared q-grams.

    The places with shared q-grams are taken in stretches with some ENTRIES of them, each longer by what the q-grams of one
    region span at most: every region is whole in one stretch, and a q-gram that many parts have fills no table.
    """
    h = window_hash(prefix, grams.q)
    where = np.flatnonzero(grams.bitmap[(h >> U(64 - BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(grams.hashes, h[where]), len(grams.hashes) - 1)
    hit = grams.hashes[at] == h[where]
    where, at = where[hit], at[hit]
    total = np.cumsum(grams.at[at + 1] - grams.at[at])
    reach = parts.text.shape[1] + 2 * int(parts.edits.max(initial=0))
    keys, i = [np.zeros(0, dtype=np.int64)], 0
    while i < len(where):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + ENTRIES, "right")))
        end = int(np.searchsorted(where, where[j - 1] + reach, "right"))
        keys.append(_bands(where[i:end], at[i:end], parts, grams))
        i = j if end < len(where) else end
    key = np.unique(np.concatenate(keys))
    part = key >> 40
    return part, (key & ((1 << 40) - 1)) * (parts.edits[part] + 1) - parts.text.shape[1]


def _bands(where: np.ndarray, at: np.ndarray, parts: Parts, grams: Grams) -> np.ndarray:
    """Part and band, as one number, of the bands with enough of these q-grams."""
    count = grams.at[at + 1] - grams.at[at]
    entry = np.repeat(grams.at[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    part = grams.part[entry]
    # Each diagonal is in two bands of twice the width; any two diagonals that differ by less than the width share one.
    band = (np.repeat(where, count) - grams.place[entry] + parts.text.shape[1]) // (parts.edits[part] + 1)
    key = np.concatenate([part << 40 | band, part << 40 | (band - 1) & ((1 << 40) - 1)])
    key = key[(key & ((1 << 40) - 1)) != (1 << 40) - 1]
    key, n = np.unique(key, return_counts=True)
    return key[n >= parts.least[key >> 40]]


def align(data: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, diagonal: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Least edits from the whole part to a stretch of data[low:high], and its end, for each candidate: alignment within the band and k around it."""
    n = len(part)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    k = parts.edits[part]
    first = diagonal - k
    width = int((4 * k + 3).max())
    column = np.arange(width)
    far = 1 << 20
    # row r, column c: r characters of the part against a stretch that ends before data[first + r + c]
    legal = lambda r: (first[:, None] + r + column >= low[:, None]) & (first[:, None] + r + column <= high[:, None])
    cost = np.where(legal(0), 0, far)
    best, end = np.full(n, far), np.zeros(n, dtype=np.int64)
    for r in range(1, int(parts.length[part].max()) + 1):
        place = first[:, None] + r - 1 + column
        char = data[np.clip(place, 0, len(data) - 1)]
        fits = (place >= low[:, None]) & (place < high[:, None])
        swap = cost + np.where(fits, char != parts.text[part, r - 1][:, None], far)
        gone = np.concatenate([cost[:, 1:], np.full((n, 1), far)], axis=1) + 1
        cost = np.where(legal(r), np.minimum(swap, gone), far)
        cost = np.minimum.accumulate(cost - column, axis=1) + column
        cost = np.where(legal(r), cost, far)
        done = parts.length[part] == r
        if done.any():
            at = np.argmin(cost[done], axis=1)
            best[done] = cost[done].min(axis=1)
            end[done] = first[done] + r + at
    return best, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 120, rate: float = 0.08, block: int = 20_000) -> DataFrame:
    """All rows and columns of docs with leak_items, the items of which a part is in the text, and leaks: (item, end, edits).

    A part is an item of up to 1.5 sizes, or a stretch of size characters of a longer one; it is in a text if some stretch is
    within rate times its length edits of it. Case, blanks and punctuation don't count. A short item allows no edits (under
    13 bytes at 8 %) and is in a text wherever its bytes are, within words too; one of no letters or digits matches nothing. end: where the stretch ends, in bytes of the text.

    Items are cut into parts by Spark; the parts are sorted and broadcast block at a time, each a table of bounded size. After
    each block but the last the texts with what was found are written, so a benchmark of any size takes so many passes, one
    after the other. Null texts, null items and null ids match nothing. Empty tables: no leaks. Columns named leak* are replaced.
    """
    out = docs.drop("leaks", "leak_items")
    out = out.withColumn("leaks", F.array().cast("array<struct<item:bigint,end:bigint,edits:bigint>>"))
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))

    def cut(batches):
        for batch in batches:
            rows = [(i, x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in parts_of(text, size, rate)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["item", "part"])

    parts = materialise(items.mapInArrow(cut, "item long, part binary").distinct(), "leak-parts")
    after, written = None, None
    while True:
        rows = (parts if after is None else parts.where((F.col("item") > after[0]) | (F.col("item") == after[0]) & (F.col("part") > F.lit(bytes(after[1]))))).orderBy("item", "part").limit(block).collect()
        if rows:
            out = _scan(out, index_parts([(r.item, bytes(r.part)) for r in rows], rate), text_col)
            after = tuple(rows[-1])
        if len(rows) < block:
            return out.withColumn("leak_items", F.array_sort(F.array_distinct(F.col("leaks.item"))))
        before, written = written, materialise(out, "leak-texts")
        out = written
        if before is not None:
            discard(before)


def _pieces(data: np.ndarray, at: np.ndarray, reach: int):
    """(plain bytes, the texts' offsets in them, where each was): a long text comes in pieces, each after the last reach plain bytes before it.

    So what is within reach plain bytes is whole in some piece, however many other bytes stand between them.
    """
    if len(at) > 2 or len(data) <= PIECE:
        yield plain(data, at)
        return
    text, was = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    for start in range(0, len(data), PIECE):
        # after a blank the run of other bytes goes on; any other byte was the one just before, and tells that a blank may follow
        text, was = text[-reach:], was[-reach:]
        again = int(len(text) > 0 and text[-1] != 0x20)
        more, _, place = plain(data[start - again : start + PIECE], np.array([0, min(PIECE, len(data) - start) + again]))
        text, was = np.concatenate([text, more[again:]]), np.concatenate([was, place[again:] + start - again])
        yield text, np.array([0, len(text)]), was


def _scan(docs: DataFrame, parts: Parts, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    place, given = docs.columns.index(text_col), docs.columns.index("leaks")
    kind = pa.list_(pa.struct([("item", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))

    def scan(batches):
        parts = shared.value
        reach = parts.text.shape[1] + 2 * int(parts.edits.max(initial=0))
        for batch in batches:
            found = batch.column(given).to_pylist()
            for row, _, data, text_at in slices(batch.column(place)):
                for text, at, was in _pieces(data, text_at, reach):
                    prefix = prefix_hash(text)
                    for grams in parts.grams:
                        for own, end, item, edits in _leaks(text, at, prefix, parts, grams):
                            where = int(was[end - 1]) + 1 - int(text_at[own]) if end > at[own] else 0
                            found[row + own].append({"item": item, "end": where, "edits": edits})
            columns = list(batch.columns)
            unique = [sorted({(x["item"], x["end"], x["edits"]) for x in f}) for f in found]
            columns[given] = pa.array([[dict(zip(("item", "end", "edits"), x, strict=True)) for x in f] for f in unique], kind)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(scan, StructType(list(docs.schema)))


def _leaks(text: np.ndarray, at: np.ndarray, prefix: np.ndarray, parts: Parts, grams: Grams):
    """(text, end, item, edits) of the candidates that alignment confirms."""
    parts_of_band, diagonals = candidates(prefix, parts, grams)
    last = max(len(text) - 1, 0)
    for k in range(0, len(parts_of_band), TRIES):
        part, diagonal = parts_of_band[k : k + TRIES], diagonals[k : k + TRIES]
        # a band may touch several texts: the one where the part's middle would be, and the ones at its ends
        edge = lambda x: np.searchsorted(at, np.clip(x, 0, last), "right") - 1
        ends = [edge(diagonal + parts.edits[part] + parts.length[part] // 2), edge(diagonal - parts.edits[part]), edge(diagonal + 3 * parts.edits[part] + 2 + parts.length[part])]
        tries = np.unique(np.concatenate([np.stack([np.arange(len(part)), e], axis=1) for e in ends]), axis=0)
        which, own = tries[:, 0], tries[:, 1]
        part, diagonal = part[which], diagonal[which]
        edits, end = align(text, at[own], at[own + 1], part, diagonal, parts)
        for n in np.flatnonzero(edits <= parts.edits[part]):
            yield int(own[n]), int(end[n]), int(parts.item[part[n]]), int(edits[n])

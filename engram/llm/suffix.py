"""Suffix-array dedup: repeated byte strings, found by a logarithmic family of sparse suffix arrays.

A suffix array of all bytes would be many times the text. Here it holds the suffixes at sampled positions: of the
positions of each length-byte window the one whose following PREFIX bytes have the smallest hash (the leftmost such). All
copies of a window sample the same place, so two equal windows meet as two entries with equal prefixes. An entry keeps,
with the prefix's fingerprint by which the array is sorted, the run of windows that chose it and a fingerprint of the
bytes that they span.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.llm.bytetext import U, mixed, prefix_hash, range_hash, slices, window_hash
from engram.llm.shared import materialise

PREFIX = 32
ENTRY = np.dtype([("prefix", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("windows", "<i2"), ("batch", "<i2")])
WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<i4")])
REMOVED = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
#: From as many different spans of one prefix on, windows are dealt out one by one and not by prefix.
MANY = 512
NO_ID = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, size: int, f) -> np.ndarray:
    """f (minimum or maximum) over x[i : i + size]."""
    got, width = x, 1
    while 2 * width <= size:
        got, width = f(got[:-width], got[width:]), 2 * width
    return got if width == size else f(got[: len(x) - size + 1], got[size - width :])


def sample(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled positions of all texts: prefix and span fingerprints, first window, number of windows and text of each."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty.astype(U), empty.astype(U), empty, empty, empty
    whole = prefix_hash(data)
    h = window_hash(whole, PREFIX)
    width = length - PREFIX + 1
    least = _sliding(h, width, np.minimum)  # of window i
    most = _sliding(np.concatenate([np.zeros(width - 1, dtype=U), least, np.zeros(width - 1, dtype=U)]), width, np.maximum)
    can = h == most[: len(h)]
    places = np.append(np.flatnonzero(can), 0)
    nth = np.cumsum(can)[: len(least)] - can[: len(least)]
    todo = np.arange(len(least))
    while len(todo := todo[h[places[nth[todo]]] != least[todo]]):
        nth[todo] += 1
    text = np.searchsorted(at, np.arange(len(least)), "right") - 1 if len(at) > 2 else np.zeros(len(least), dtype=np.int64)
    fits = np.flatnonzero(np.arange(len(least)) + length <= at[1:][np.minimum(text, len(at) - 2)])
    if not len(fits):
        return empty.astype(U), empty.astype(U), empty, empty, empty
    chosen, own = places[nth[fits]], text[fits]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1]) | (fits[1:] != fits[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(fits)) - 1
    start, end, place = fits[first], fits[last] + length, chosen[first]
    with np.errstate(over="ignore"):
        span = mixed(range_hash(whole, start, end) + (place - start).astype(U) * U(0xA0761D6478BD642F))
    return h[place], span, start, fits[last] - fits[first] + 1, own[first]


def _earliest(*keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, doc and start; in that order, whether a row is the first of its keys, and whether it starts later than that."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (doc[order] != doc[order][head]) | (start[order] != start[order][head]) if len(order) else new
    return order, new, later


class Family:
    """Levels of sorted entries with different (prefix, span), each level at least twice the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def append(self, batch: np.ndarray) -> np.ndarray:
        """Takes a batch of later documents in; returns those of its entries that repeat an entry of the family or of the batch."""
        order, new, later = _earliest(batch["prefix"], batch["span"], doc=batch["doc"], start=batch["start"])
        batch = batch[order]
        repeats, batch = [batch[later]], batch[new]
        for level in self.levels:
            known = self._in(level, batch)
            repeats.append(batch[known])
            batch = batch[~known]
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            both = np.concatenate([self.levels.pop(), self.levels.pop()])
            self.levels.append(both[np.lexsort((both["span"], both["prefix"]))])
        return np.concatenate(repeats)

    @staticmethod
    def _in(level: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """Merge scan: both are sorted by (prefix, span)."""
        both = np.concatenate([level, batch])
        order = np.lexsort((np.arange(len(both)), both["span"], both["prefix"]))
        p, s = both["prefix"][order], both["span"][order]
        same = np.zeros(len(both), dtype=bool)
        if len(both) > 1:
            same[order[1:]] = (p[1:] == p[:-1]) & (s[1:] == s[:-1])
        return same[len(level) :]

    def entries(self) -> np.ndarray:
        return np.concatenate(self.levels) if self.levels else np.zeros(0, dtype=ENTRY)


def _packed(rows: np.ndarray) -> bytes:
    """Column by column, which Spark's compression of shuffles makes smaller."""
    return b"".join(rows[c].tobytes() for c in rows.dtype.names)


def _unpacked(blocks: list, kind: np.dtype) -> np.ndarray:
    out = np.zeros(sum(b.size for b in blocks) // kind.itemsize, dtype=kind)
    at = 0
    for b in blocks:
        n, skip = b.size // kind.itemsize, 0
        for c in kind.names:
            out[c][at : at + n] = np.frombuffer(b, dtype=kind[c], count=n, offset=skip)
            skip += n * kind[c].itemsize
        at += n
    return out


def _blocks(rows: np.ndarray, kind: int, key: np.ndarray, buckets: int):
    """(bucket, kind, block) for each bucket that rows go to by key; in a block rows are in order of documents."""
    bucket = (key % U(buckets)).astype(np.int64)
    order = np.lexsort((rows["start"], rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else []
    for i, c in enumerate(cuts):
        yield int(bucket[c]), kind, _packed(rows[c : cuts[i + 1] if i + 1 < len(cuts) else None])


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "block"])


def _of_kind(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    return _unpacked([b.as_buffer() for k, b in zip(table.column("kind").to_pylist(), table.column("block"), strict=True) if k == kind], dtype)


#: Rows that a task holds before it settles and sends them.
HELD = 1 << 19
BLOCKS = "bucket int, kind int, block binary"
FOUND = "doc long, start int, end int, prefix long, many boolean"


def _found(removed: np.ndarray, entries: np.ndarray | None = None, many: np.ndarray | None = None) -> pa.Table:
    """Removed runs, with null prefixes, and entries whose windows are still to be compared."""
    n, m = len(removed), 0 if entries is None else len(entries)
    col = lambda a, b: np.concatenate([a, b]) if m else a
    doc = col(removed["doc"], entries["doc"] if m else None)
    start = col(removed["start"], entries["start"] if m else None)
    end = col(removed["end"], (entries["start"] + entries["windows"]) if m else None)
    prefix = np.concatenate([np.zeros(n, dtype=np.int64), entries["prefix"].view(np.int64) if m else np.zeros(0, dtype=np.int64)])
    is_null = np.concatenate([np.ones(n, dtype=bool), np.zeros(m, dtype=bool)])
    flag = np.concatenate([np.zeros(n, dtype=bool), many if m else np.zeros(0, dtype=bool)])
    return pa.table([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(prefix, pa.int64(), mask=is_null), pa.array(flag, pa.bool_())], ["doc", "start", "end", "prefix", "many"])


def _runs(entries: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(entries), dtype=REMOVED)
    out["doc"], out["start"] = entries["doc"], entries["start"]
    out["end"] = entries["start"] + entries["windows"] - 1 + length
    return out


def repeated_runs(docs: DataFrame, length: int = 100, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """Rows (doc, start, end): runs of bytes of length or more that also start earlier (a smaller id, or earlier in the text).

    Runs may overlap. Each byte that has to go is in one, and no other.

    1. Documents arrive in batches of id ranges. Every text is sampled; entries are dealt into buckets by prefix. A bucket
       keeps a Family: batches are merge-scanned against its levels and taken in. An entry whose whole span is known is
       a repeat. Equal spans of a slice are settled before they are dealt out.
    2. Prefixes that have several different spans are compared window by window: the spans' bytes are fetched by a
       join with the texts, and of equal windows all but the earliest are repeats. Windows of a prefix with MANY spans
       are dealt out one by one, again settled within a slice first, so that a line that is everywhere fills no bucket.

    The number of buckets follows the bytes of text, so that one holds bucket_bytes of text's entries on average.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    some = texts.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc", [k / batches for k in range(1, batches)] or [0.5], 1000)).first()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(some[0] or 0) // bucket_bytes))
    cuts = np.array(some[1] or [], dtype=np.int64)

    def send_entries(held):
        e = np.concatenate(held)
        order, new, later = _earliest(e["prefix"], e["span"], doc=e["doc"], start=e["start"])
        e = e[order]
        removed = _runs(e[later], length)
        return _batch_of([*_blocks(e[new], 0, e[new]["prefix"], buckets), *_blocks(removed, 1, mixed(removed["doc"].astype(U)), buckets)])

    def entries_of(batches_in):
        for batch in batches_in:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held = [np.zeros(0, dtype=ENTRY)]
            for row, end, data, at in slices(batch.column(1)):
                prefix, span, start, windows, own = sample(data, at, length)
                e = np.zeros(len(prefix), dtype=ENTRY)
                e["prefix"], e["span"], e["doc"], e["start"], e["windows"] = prefix, span, ids[row:end][own], start - at[own], windows
                e["batch"] = np.searchsorted(cuts, e["doc"], "left")
                held.append(e)
                if sum(map(len, held)) >= HELD:
                    yield send_entries(held)
                    held = held[:1]
            yield send_entries(held)

    def scan(table: pa.Table) -> pa.Table:
        removed, e = [_of_kind(table, 1, REMOVED)], _of_kind(table, 0, ENTRY)
        family = Family()
        for k in np.unique(e["batch"]):
            removed.append(_runs(family.append(e[e["batch"] == k]), length))
        e = family.entries()
        e = e[np.argsort(e["prefix"], kind="stable")]
        _, which, n = np.unique(e["prefix"], return_inverse=True, return_counts=True)
        shared = n[which] > 1
        return _found(np.concatenate(removed), e[shared], n[which][shared] >= MANY)

    by = texts.mapInArrow(entries_of, BLOCKS).groupBy("bucket")
    found = materialise(by.applyInArrow(scan, FOUND), "suffix-entries")

    spans = found.where("prefix IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("start", "end", "prefix", "many")).alias("spans"))

    def send_windows(out, keys):
        w, key = np.concatenate(out), np.concatenate(keys)
        order, new, later = _earliest(w["hash"], doc=w["doc"], start=w["start"])
        again = _windows(w[order][later], length)
        return _batch_of([*_blocks(w[order][new], 0, key[order][new], buckets), *_blocks(again, 1, mixed(again["doc"].astype(U)), buckets)])

    def windows_of(batches_in):
        for batch in batches_in:
            lists = batch.column(2)
            flat = lists.flatten()
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), n)
            start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            prefix, many = flat.field(2).to_numpy(zero_copy_only=False).view(U), flat.field(3).to_numpy(zero_copy_only=False)
            out, keys = [np.zeros(0, dtype=WINDOW)], [np.zeros(0, dtype=U)]
            for row, stop, data, at in slices(batch.column(1)):
                mine = slice(*np.searchsorted(owner, [row, stop]))
                own, s, count = owner[mine] - row, start[mine], (end - start)[mine]
                ok = s + count + length - 1 <= np.diff(at)[own]  # a row with another text and the same id
                own, s, count, key, spread = own[ok], s[ok], count[ok], prefix[mine][ok], many[mine][ok]
                hashes = window_hash(prefix_hash(data), length)
                k = np.repeat(np.arange(len(s)), count)
                where = s[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
                w = np.zeros(len(k), dtype=WINDOW)
                w["hash"], w["doc"], w["start"] = hashes[at[own][k] + where], ids[row:stop][own][k], where
                out.append(w)
                keys.append(np.where(spread[k], w["hash"], mixed(key)[k]))
                if sum(map(len, out)) >= HELD:
                    yield send_windows(out, keys)
                    out, keys = out[:1], keys[:1]
            yield send_windows(out, keys)

    def compare(table: pa.Table) -> pa.Table:
        removed, w = _of_kind(table, 1, REMOVED), _of_kind(table, 0, WINDOW)
        order, _, later = _earliest(w["hash"], doc=w["doc"], start=w["start"])
        return _found(np.concatenate([removed, _windows(w[order][later], length)]))

    by = texts.join(spans, "doc").mapInArrow(windows_of, BLOCKS).groupBy("bucket")
    windows = by.applyInArrow(compare, FOUND)
    return found.where("prefix IS NULL").unionByName(windows).select("doc", "start", "end")


def _windows(w: np.ndarray, length: int) -> np.ndarray:
    """Windows as runs, those of neighbouring starts joined."""
    order = np.lexsort((w["start"], w["doc"]))
    doc, start = w["doc"][order], w["start"][order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]) if len(w) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1 if len(w) else first
    out = np.zeros(len(first), dtype=REMOVED)
    out["doc"], out["start"], out["end"] = doc[first], start[first], start[last] + length
    return out


def dedup_substrings(docs: DataFrame, length: int = 100, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id, n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256, and spans, the (start, end) of the runs.

    Texts are UTF-8 bytes, null is empty; nothing matches across documents. What is removed is judged on the input alone.
    Rows with the same id are one document at the same place: they aren't copies of each other. A null id
    is after all others. Empty table: empty.
    """
    runs = repeated_runs(docs, length, batches, id_col, text_col)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    schema = docs.select(id_col).schema

    def cut(batches_in):
        for batch in batches_in:
            texts, lists = batch.column("text"), batch.column("runs")
            out = []
            for text, runs in zip(texts, lists, strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                at, kept, spans = 0, hashlib.sha256(), []
                if runs.is_valid:
                    s, e = (runs.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.minimum(np.maximum.accumulate(e[order]), len(raw))
                    s, e = s[s < len(raw)], e[: np.count_nonzero(s < len(raw))]
                    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, dtype=bool)
                    first = np.flatnonzero(new)
                    spans = [(int(s[a]), int(e[b - 1])) for a, b in zip(first, np.append(first[1:], len(s)), strict=True)] if len(s) else []
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    for field in StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"):
        schema = schema.add(field)
    return texts.join(runs, "doc", "left").drop("doc").mapInArrow(cut, schema)

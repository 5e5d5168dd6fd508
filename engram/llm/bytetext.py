"""Texts of an Arrow column as bytes in numpy: prefix hashes, words and shingles, a slice of a quarter of a megabyte at a time.

Hashes are polynomial modulo 2^64 with a fixed odd base, finished by a mixer: equal strings have equal hashes in every
task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes of a slice: a task holds some twenty arrays of eight times that.
SLICE = 1 << 18
#: Bytes of a word: all but blank, tab, line feed, vertical tab, form feed and carriage return.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts in them). Null is empty. A text is never divided."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    ones = lambda x: np.concatenate([np.ones(1, dtype=U), np.full(n - 1, x, dtype=U)])
    with np.errstate(over="ignore"):
        return np.cumprod(ones(U(BASE))), np.cumprod(ones(U(pow(BASE, -1, 1 << 64))))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n or more."""
    return _powers(max(19, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P of one more than the bytes; P[j] - P[i], divided by base^i, is the hash of bytes i to j."""
    up, _ = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, dtype=U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])])


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of that many bytes, by their start."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, dtype=U)
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mixed((prefix[size:] - prefix[:n]) * down[:n])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and at[i] to at[i + 1] the words of text i."""
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingles(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of that many words, A-Z lower-cased, and offsets by text; a shorter text has one, of all its words.

    Repeats within a text stay.
    """
    starts, ends, of = words(data, at)
    word = range_hash(prefix_hash(LOWER[data]), starts, ends)
    up, _ = powers(size + 1)
    n = np.diff(of)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(of[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    length = np.repeat(np.minimum(n, size), count)
    with np.errstate(over="ignore"):
        total = length.astype(U) * U(0xC2B2AE3D27D4EB4F)
        for k in range(size):
            some = length > k
            total[some] += word[first[some] + k] * up[k + 1]
    return mixed(total), out_at

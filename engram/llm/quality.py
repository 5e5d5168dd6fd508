"""Quality classifier: logistic regression over hashed n-grams of words, trained by follow the regularised leader.

A text's words are read in two spellings, in lower case and as a shape (runs of capitals, of other letters and of
digits, other signs as they are), because junk is often told by how words are set rather than by which they are. The
n-grams of both are hashed into one table of weights. A feature's value is its share of the text's n-grams, so a score is the
mean weight of what the text holds: a sparse dot product that long texts pile up piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from engram.llm.bytetext import IN_WORD, LOWER, SLICE, U, mixed, prefix_hash, range_hash, slices, words
from engram.llm.shared import discard, materialise

#: Weights are 2^BITS and one that all texts share.
BITS = 18
BIAS = 1 << BITS
#: Longer runs of bytes without a blank are several words.
WORD = 256
#: A feature that is all of a text has this value.
SCALE = 32.0
#: Spelling (0 in lower case, 1 shape) and words of each kind of n-gram.
KINDS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))
REACH = max(n for _, n in KINDS) - 1
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def spellings(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in both spellings (2 x words) and the texts' offsets in them."""
    starts, ends, of = words(data, at)
    if (ends - starts > WORD).any():
        times = -(-(ends - starts) // WORD)
        first = np.repeat(starts, times)
        step = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
        starts, ends = first + WORD * step, np.minimum(first + WORD * (step + 1), np.repeat(ends, times))
        of = np.searchsorted(starts, at)
    shape = _SHAPE[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    before = np.concatenate([[0], np.cumsum(new)])
    kept = prefix_hash(shape[new])
    # the run that a word starts with is its own, and the one it ends with began in it
    return np.stack([range_hash(prefix_hash(LOWER[data]), starts, ends), range_hash(kept, before[starts], before[ends])]), of


def ngrams(spelt: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind (ends, ids): the words at which the n-grams end and their numbers; place is each word's place in its text."""
    for spelling, n in KINDS:
        ends = np.flatnonzero(place >= n - 1)
        with np.errstate(over="ignore"):
            h = np.full(len(ends), U(spelling * 8 + n), dtype=U)
            for k in range(n):
                h = h * U(0x9E3779B97F4A7C15) + spelt[spelling][ends - k]
        yield ends, (mixed(h) >> U(64 - BITS)).astype(np.int64)


def pieces(data: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of at most limit bytes, cut after a blank; in a run without one at a multiple of WORD from its start, as limit is such a multiple. So no word is in two."""
    start = 0
    while start < len(data):
        end = start + limit
        if end < len(data):
            blank = np.flatnonzero(~IN_WORD[data[start:end]])
            end = start + int(blank[-1]) + 1 if len(blank) else end
        yield start, min(end, len(data))
        start = end


def grams_of(data: np.ndarray, limit: int = SLICE) -> Iterator[np.ndarray]:
    """The numbers of one text's n-grams, piece by piece; those over a cut belong to the later piece."""
    carried, done = np.zeros((2, 0), dtype=U), 0
    for start, end in pieces(data, limit):
        spelt, _ = spellings(data[start:end], np.array([0, end - start]))
        spelt = np.concatenate([carried, spelt], axis=1)
        held = carried.shape[1]
        place = np.arange(spelt.shape[1]) + done - held
        yield np.concatenate([ids[ends >= held] for ends, ids in ngrams(spelt, place)])
        done += spelt.shape[1] - held
        carried = spelt[:, max(0, spelt.shape[1] - REACH) :]


@dataclass
class Learner:
    """State of the leader: sums of gradients (less what past weights hold) and of their squares."""

    z: np.ndarray
    n: np.ndarray
    rate: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    @classmethod
    def fresh(cls, **settings: float) -> Learner:
        return cls(np.zeros(BIAS + 1), np.zeros(BIAS + 1), **settings)

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[ids]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(self.n[ids])) / self.rate + self.l2)

    def learn(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        """One step on a text with features ids of values x."""
        w, n = self.weights(ids), self.n[ids]
        g = (sigmoid(w @ x) - label) * x
        squares = n + g * g
        self.z[ids] += g - (np.sqrt(squares) - np.sqrt(n)) / self.rate * w
        self.n[ids] = squares


def sigmoid(v: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(v, -700, 700)))


def features(data: np.ndarray, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of one text's features, and the one of all texts."""
    count = np.zeros(0, dtype=np.int64)
    ids = np.zeros(0, dtype=np.int64)
    for more in grams_of(data, limit):
        ids, where = np.unique(np.concatenate([ids, more]), return_inverse=True)
        count = np.bincount(where, np.concatenate([count, np.ones(len(more), dtype=np.int64)]), minlength=len(ids)).astype(np.int64)
    return np.append(ids, BIAS), np.append(SCALE * count / max(int(count.sum()), 1), 1.0)


def _sampled(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, label) of at most max_rows ids, those with the least hashes; ids with both labels or none are left out."""
    label = F.col(label_col)
    told = labels.where(F.col(id_col).isNotNull() & label.isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    told = told.where("label = most").select("id", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)).alias("place"))
    told = materialise(told, "labels")
    least, n = 1 << 30, told.count()
    while n > max_rows:
        least = int(least * min(0.98 * max_rows / n, 0.999))
        n = told.where(F.col("place") < least).count()
    return told.where(F.col("place") < least)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 1 << 15, shards: int = 8, rounds: int = 2, **settings: float
) -> np.ndarray:
    """Weights learnt from labels (0 or 1) and the texts with their ids; from at most max_rows of them, chosen by a hash of the id.

    The sample is broadcast as ids and labels, max_rows at most, so documents stay where they are and only the chosen texts are
    shuffled. They are dealt out to shards, each of which learns its rows in order of a hash, from the state of the round before; a round's
    state is the mean of what each coordinate has gained in the shards that met it. Driver and tasks hold two tables of 2^BITS numbers.
    Of rows that repeat an id the smallest text counts; ids with two labels don't. Without labelled texts all weights are 0.
    """
    sample = _sampled(labels, id_col, label_col, max_rows)
    # a hint at most: the sample has max_rows rows of a number and a label
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    order = F.xxhash64(F.lit(12), "id")
    chosen = materialise(chosen.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("place"), "label", "text"), "labelled-texts")
    state = Learner.fresh(**settings)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, shard = None, None
        for batch in batches:
            for k, (at, label) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                if at != shard:
                    if mine is not None:
                        yield gained(mine)
                    mine, shard = Learner(state.z.copy(), state.n.copy(), **settings), at
                for _, _, data, _ in slices(batch.column("text").slice(k, 1)):
                    mine.learn(*features(data), label)
        if mine is not None:
            yield gained(mine)

    def gained(mine: Learner) -> pa.RecordBatch:
        ids = np.flatnonzero(mine.n != state.n)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "z": pa.array(mine.z[ids] - state.z[ids]), "n": pa.array(mine.n[ids] - state.n[ids])})

    for _ in range(rounds):
        rows = chosen.repartition(shards, "shard").sortWithinPartitions("shard", "place").drop("place")
        got = rows.mapInArrow(learn, "id int, z double, n double").groupBy("id").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        ids = got["id"].to_numpy()
        state.z[ids] += got["z"].to_numpy()
        state.n[ids] += got["n"].to_numpy()
    discard(chosen)
    return state.weights()


def _scores(column: pa.Array, weights: np.ndarray, limit: int = SLICE) -> np.ndarray:
    """Each text's sum of weights over its n-grams, as a share of them."""
    out = []
    for row, end, data, at in slices(column, limit):
        if end == row + 1 and len(data) > limit:
            total, n = 0.0, 0
            for ids in grams_of(data, limit):
                total, n = total + float(weights[ids].sum()), n + len(ids)
            out.append(np.array([total / max(n, 1)]))
            continue
        spelt, of = spellings(data, at)
        text = np.repeat(np.arange(end - row), np.diff(of))
        total, n = np.zeros(end - row), np.zeros(end - row)
        for ends, ids in ngrams(spelt, np.arange(len(text)) - of[:-1][text]):
            total += np.bincount(text[ends], weights[ids], minlength=end - row)
            n += np.bincount(text[ends], minlength=end - row)
        out.append(total / np.maximum(n, 1))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with quality_score, from 0 to 1 and higher where label 1 is likelier, and quality_predicted, 1 from least on.

    Whole texts count, in memory bounded by a slice whatever their length; words of over 256 bytes are several. A text without words, empty
    or null has the score of the weight that all texts share. Columns of docs with the two names are replaced; empty table: empty.
    """
    keep = [c for c in docs.columns if c not in ("quality_score", "quality_predicted")]
    schema = docs.select(*keep).schema.add("quality_score", DoubleType()).add("quality_predicted", IntegerType())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sigmoid(weights[BIAS] + SCALE * _scores(batch.column(text_col), weights))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= least).astype(np.int32))], [*keep, "quality_score", "quality_predicted"])

    return docs.select(*keep).mapInArrow(judge, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows of the quarter that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))

"""A stored positional index of texts: postings in immutable segments by hash of the term, and ranking by covers.

A cover is a shortest stretch of a text that satisfies a query: no other such stretch lies within it. A text's rank sums a
tenth over one more than the words of each cover that the query doesn't ask for, so words close together count more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.batches import small
from engram.operators.cut import cut
from engram.functions.stems import stem
from engram.operators.search import tokens, web_query
from engram.operators.stemmed import Groups, stemmed_query
from engram.operators.table import Conflict, Versioned

#: What a cover without other words counts.
WEIGHT = 0.1


class Plan:
    """A query's alternatives, each of units (negative, numbers of words): words by number, those asked for first."""

    def __init__(self, query: str | Groups):
        groups = web_query(query) if isinstance(query, str) else query
        asked = sorted({w for g in groups for negative, words in g if not negative for w in words})
        self.asked = len(asked)
        self.words = asked + sorted({w for g in groups for negative, words in g if negative for w in words} - set(asked))
        number = {w: k for k, w in enumerate(self.words)}
        self.groups = [[(negative, tuple(number[w] for w in words)) for negative, words in g] for g in groups]
        self.needs_all = any(all(negative for negative, _ in g) for g in self.groups)

    def judge(self, at: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text fits, and its rank: at[i] to at[i + 1] are the entries (number of a word, place) of text i in order of place."""
        texts = len(at) - 1
        text = np.repeat(np.arange(texts), np.diff(at))
        fits = np.zeros(texts, dtype=bool)
        for g in self.groups:
            one = np.ones(texts, dtype=bool)
            for negative, unit in g:
                has = np.bincount(text[self._ends(unit, text, word, place)], minlength=texts) > 0
                one &= ~has if negative else has
            fits |= one
        kept = word < self.asked
        text, word, place = text[kept], word[kept], place[kept]
        n = len(text)
        first = np.searchsorted(text, np.arange(texts))[text] if n else text
        start = np.full(n, -1)
        for g in self.groups:
            units = [unit for negative, unit in g if not negative]
            mine = np.full(n, n if units else -1)
            for unit in units:
                ends = self._ends(unit, text, word, place)
                last = np.full(n, -1)
                last[ends] = ends - len(unit) + 1
                last = np.maximum.accumulate(last) if n else last
                mine = np.minimum(mine, np.where(last >= first, last, -1))
            start = np.maximum(start, mine)
        before = np.concatenate([[-1], start[:-1]]) if n else start
        new = np.flatnonzero((start >= 0) & (start > np.where(np.arange(n) == first, -1, before)))
        noise = (place[new] - place[start[new]]) - (new - start[new])
        return fits, np.bincount(text[new], WEIGHT / (1 + noise), minlength=texts).astype(np.float64)

    @staticmethod
    def _ends(unit: tuple[int, ...], text: np.ndarray, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Entries at which the words of a unit end, one after the other."""
        n = len(unit)
        ends = np.flatnonzero(word == unit[-1])
        ends = ends[ends >= n - 1]
        for j in range(1, n):
            ends = ends[(word[ends - j] == unit[-1 - j]) & (text[ends - j] == text[ends]) & (place[ends - j] == place[ends] - j)]
        return ends


def cover_rank(query: str, text: Column) -> Column:
    """A text's rank by covers, from its words; 0 for null, for texts without the query's words and for an empty query."""
    plan = Plan(query)
    if not plan.asked:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def ranked(words: pd.Series, places: pd.Series) -> pd.Series:
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        flat = lambda s: np.concatenate([np.asarray(x, dtype=np.int64) for x in s]) if len(s) else np.zeros(0, dtype=np.int64)
        return pd.Series(plan.judge(at, flat(words), flat(places))[1])

    number = F.create_map(*[F.lit(x) for k, w in enumerate(plan.words[: plan.asked]) for x in (w, k)])
    entries = F.filter(F.transform(tokens(text), lambda w, k: F.struct(F.try_element_at(number, w).alias("w"), k.alias("k"))), lambda x: x["w"].isNotNull())
    return ranked(entries["w"], entries["k"])


def _postings_of(texts: DataFrame) -> DataFrame:
    """(token, id, places) of texts (id, words): a row for each word of each text, made where the text is, without a shuffle."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().dictionary_encode()
            if not len(flat):
                continue
            text = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
            mark = text * len(flat.dictionary) + flat.indices.to_numpy()
            order = np.argsort(mark, kind="stable")
            mark = mark[order]
            first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(mark)), pa.int32()), pa.array(place[order], pa.int32()))
            word, of = flat.indices.take(pa.array(order[first])), pa.array(text[order[first]])
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(word), batch.column("id").take(of), places], ["token", "id", "places"])

    return small(texts).mapInArrow(grouped, f"token string, id {dict(texts.dtypes)['id']}, places array<int>")


class TextIndex(Versioned):
    """Postings (token, id, places) and ids of texts, in immutable segments; a manifest says which count and which ids are gone from which.

    A segment's postings are in buckets by hash of the token, so a search reads the folders of its own words. add() makes a segment and merges
    the newest ones while the last is at least half as large as the one before, so there are as many as the logarithm of the texts. remove() keeps ids
    aside; merging drops them. An id that is added again is another text beside the old one unless that is removed first (replace() does both).
    An english index holds English stems in place of words and takes queries by stems; stop words are held too, as phrases ask for them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, rows_per_file: int = 4_000_000, english: bool = False):
        super().__init__(spark, path)
        self.buckets, self.rows_per_file, self.english = buckets, rows_per_file, english

    def manifest(self, version: int | None = None) -> dict:
        return self._read(version, {"version": 0, "segments": [], "gone": []})

    def _change(self, change) -> dict:
        """Commits change(manifest), anew if another writer was first."""
        while True:
            now = self.manifest()
            try:
                return self.commit(change(now) | {"version": now["version"] + 1})
            except Conflict:
                continue

    def _write(self, postings: DataFrame, ids: DataFrame) -> dict:
        """A segment: its name and numbers of texts and postings."""
        name = uuid.uuid4().hex
        ids.write.parquet(f"{self.path}/ids/segment={name}")
        n = self.spark.read.parquet(f"{self.path}/ids/segment={name}").count()
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")
        # a bucket is in several tasks where there are many texts, so a word that all of them have is too
        salts = max(1, -(-n // 200_000))
        rows = postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "token")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        return {"name": name, "texts": n}

    def add(self, texts: DataFrame, id_col: str = "id", text_col: str = "content") -> dict:
        """Indexes texts as a segment, then merges segments of like size. Null and empty texts have an id and no postings."""
        postings = _postings_of(texts.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")))
        if self.english:  # a word is stemmed once for a text; words of one stem then meet
            postings = postings.groupBy(stem(F.col("token")).alias("token"), "id").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        new = self._write(postings, texts.select(F.col(id_col).alias("id")))
        out = self._change(lambda now: now | {"segments": [*now["segments"], new]} if new["texts"] else now)
        while len(s := out["segments"]) > 1 and s[-1]["texts"] * 2 >= s[-2]["texts"]:
            out = self._merge(out, s[-2:])
        return out

    def _merge(self, now: dict, some: list[dict]) -> dict:
        postings, ids = self._postings(now, None, some), self._ids(now, some)
        new = self._write(postings, ids)
        names = [s["name"] for s in some]

        def change(latest: dict) -> dict:
            have = [s["name"] for s in latest["segments"]]
            if not set(names) <= set(have):
                return latest  # another writer has merged one of them
            segments = [new if s["name"] == names[-1] else s for s in latest["segments"] if s["name"] not in names[:-1]]
            # what was removed while this merge ran is gone from the new segment too
            gone = [g | {"from": [*(x for x in g["from"] if x not in names), *([new["name"]] if g not in now["gone"] and set(names) & set(g["from"]) else [])]} for g in latest["gone"]]
            return latest | {"segments": segments, "gone": [g for g in gone if g["from"]]}

        return self._change(change)

    def remove(self, ids: DataFrame) -> dict:
        """The texts with these ids are gone from all segments that there are."""
        name = uuid.uuid4().hex
        ids.select("id").where("id IS NOT NULL").distinct().write.parquet(f"{self.path}/gone/{name}")
        return self._change(lambda now: now | {"gone": [*now["gone"], {"name": name, "from": [s["name"] for s in now["segments"]]}]})

    def replace(self, texts: DataFrame, id_col: str = "id", text_col: str = "content") -> dict:
        self.remove(texts.select(F.col(id_col).alias("id")))
        return self.add(texts, id_col, text_col)

    def _left(self, now: dict, rows: DataFrame) -> DataFrame:
        """rows (id, segment, ..) without those that are gone."""
        for g in now["gone"]:
            gone = self.spark.read.parquet(f"{self.path}/gone/{g['name']}").withColumn("_gone", F.lit(True))
            rows = rows.join(gone, "id", "left").where(F.col("_gone").isNull() | ~F.col("segment").isin(g["from"])).drop("_gone")
        return rows

    def _ids(self, now: dict, some: list[dict]) -> DataFrame:
        paths = [f"{self.path}/ids/segment={s['name']}" for s in some]
        return self._left(now, self.spark.read.option("basePath", f"{self.path}/ids").parquet(*paths).withColumn("segment", F.col("segment").cast("string"))).select("id")

    def _postings(self, now: dict, words: list[str] | None, some: list[dict]) -> DataFrame:
        """Postings (token, id, places) of segments: of all words, or of some, of which only the folders are read."""
        parts = "*"
        if words is not None:
            numbers = self.spark.createDataFrame([(w,) for w in words], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")).distinct().collect()
            parts = "{" + ",".join(str(r[0]) for r in numbers) + "}"
        out = None
        for s in some:
            folder = f"{self.path}/postings/segment={s['name']}"
            found = [x.getPath().getName() for x in (self._fs.globStatus(self._at(f"postings/segment={s['name']}/bucket={parts}")) or [])]
            if found:
                rows = self.spark.read.option("basePath", folder).parquet(*(f"{folder}/{x}" for x in found)).withColumn("segment", F.lit(s["name"]))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "token string, id bigint, places array<int>")
        out = out if words is None else out.where(F.col("token").isin(words))
        return self._left(now, out).select("token", "id", "places")

    def search(self, query: str) -> DataFrame:
        """(id, rank) of the texts that fit a query, in no order; rank by covers. Reads the query's words alone, and ids where an alternative asks for none."""
        plan, now = Plan(stemmed_query(self.spark, query) if self.english else query), self.manifest()
        if not plan.words or not now["segments"]:
            return self.spark.createDataFrame([], "id bigint, rank double")
        number = F.create_map(*[F.lit(x) for k, w in enumerate(plan.words) for x in (w, k)])
        rows = self._postings(now, plan.words, now["segments"])
        entries = F.transform("places", lambda p: F.struct(p.alias("place"), F.try_element_at(number, F.col("token")).alias("word")))
        lists = rows.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list(entries))).alias("entries"))
        if plan.needs_all:
            lists = self._ids(now, now["segments"]).distinct().join(lists, "id", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<place:int,word:int>>")))
        kind = dict(lists.dtypes)["id"]

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("entries")
                flat = column.flatten()
                at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                fits, rank = plan.judge(at, flat.field("word").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("place").to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(fits)), pa.array(rank[fits])], ["id", "rank"])

        return cut(lists).mapInArrow(judge, f"id {kind}, rank double")

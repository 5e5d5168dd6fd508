"""Search by English stems over fields that count differently."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.stems import STOP_WORDS, beginning, stem
from engram.operators.search import tokens, web_query

Groups = list[list[tuple[bool, list[str]]]]


def stemmed_query(spark: SparkSession, query: str) -> Groups:
    """A web-style query with stems in place of words. Stop words by themselves aren't asked for; in phrases they are words like others."""
    groups = [[(negative, words) for negative, words in g if len(words) > 1 or words[0] not in STOP_WORDS] for g in web_query(query)]
    words = sorted({w for g in groups for _, unit in g for w in unit})
    if not words:
        return []
    of = spark.createDataFrame([(w,) for w in words], "word string").select("word", stem(F.col("word"))).collect()
    known = {r[0]: r[1] for r in of}
    return [[(negative, [known[w] for w in unit]) for negative, unit in g] for g in groups if g]


def asked_stems(groups: Groups) -> list[str]:
    return sorted({w for g in groups for negative, unit in g if not negative for w in unit})


def _fits(groups: Groups, entries: Column) -> Column:
    def term(negative: bool, unit: list[str]) -> Column:
        def follows(e: Column) -> Column:
            after = lambda k, w: F.exists(entries, lambda x: (x["stem"] == w) & (x["field"] == e["field"]) & (x["place"] == e["place"] + k))
            return reduce(lambda a, b: a & b, [after(k, w) for k, w in enumerate(unit[1:], 1)], e["stem"] == unit[0])

        has = F.exists(entries, follows)
        return ~has if negative else has

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [term(*x) for x in g]) for g in groups])


def _rank(stems: list[str], entries: Column) -> Column:
    def share(s: str) -> Column:
        weights = F.sort_array(F.transform(F.filter(entries, lambda e: e["stem"] == s), lambda e: e["weight"]), asc=False)
        return F.aggregate(F.transform(weights, lambda w, k: w / ((k + 1) * (k + 1))), F.lit(0.0), lambda a, x: a + x)

    return sum((share(s) for s in stems), F.lit(0.0)) / (max(1, len(stems)) * math.pi**2 / 6)


def search_stems(rows: DataFrame, query: str, weights: Mapping[str, float], id_col: str, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The rows whose fields fit a query by English stems, with the column rank, the best first, then by id.

    weights: the fields and what a word in each counts. rank: for each stem that is asked for, its occurrences, the heaviest first, count their
    weight over the square of their number; the mean over the stems, over the sum of all inverse squares. So a word once in a field of weight 0.1
    gives 0.0608. A phrase lies within one field. Null fields are empty; a query of stop words alone, or of none, fits nothing. Only words that
    begin like a stem that is asked for are stemmed.
    """
    groups = stemmed_query(rows.sparkSession, query)
    some = rows if where is None else rows.where(where)
    if not groups:
        return some.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    like = beginning(sorted({w for g in groups for _, unit in g for w in unit}))

    def words(k: int, name: str, weight: float) -> Column:
        placed = F.transform(tokens(F.col(name).cast("string")), lambda w, place: F.struct(w.alias("w"), place.alias("place")))
        return F.transform(F.filter(placed, lambda x: x["w"].rlike(like)), lambda x: F.struct(stem(x["w"]).alias("stem"), F.lit(k).alias("field"), x["place"].alias("place"), F.lit(float(weight)).alias("weight")))

    # one value to a row, so that the entries of a row are found once
    entries = F.flatten(F.array(*[words(k, n, w) for k, (n, w) in enumerate(weights.items())]))
    judged = F.transform(F.array(entries), lambda e: F.struct(_fits(groups, e).alias("hit"), _rank(asked_stems(groups), e).alias("rank")))
    found = some.withColumn("_is", F.explode(F.filter(judged, lambda x: x["hit"])))
    return found.withColumn("rank", F.col("_is.rank")).drop("_is").orderBy(F.desc("rank"), id_col).limit(limit)

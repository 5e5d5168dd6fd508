"""Texts divided into sections and chunks, and JSON profiles into sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import head_tail
from engram.operators.windows import sessions


def sections(docs: DataFrame, id_col: str, text_col: str, starts: Callable[[Column, Column], Column] = lambda line, i: line.rlike("^#{1,6} ")) -> DataFrame:
    """(id, section, body): lines from one that starts a section to the next; lines before the first are section 0. Computed within a row."""
    lines = F.split(text_col, "\n")
    marks = F.filter(F.transform(lines, lambda x, i: F.when(starts(x, i), i)), lambda i: i.isNotNull())
    cuts = F.concat(F.when((F.size(marks) > 0) & (marks[0] == 0), F.array().cast("array<int>")).otherwise(F.array(F.lit(0))), marks)
    zero = F.when((F.size(marks) > 0) & (marks[0] == 0), 1).otherwise(0)
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.size(lines)))
    parts = F.transform(F.arrays_zip(cuts.alias("a"), ends.alias("b")), lambda p: F.array_join(F.slice(lines, p["a"] + 1, p["b"] - p["a"]), "\n"))
    return docs.select(id_col, zero.alias("_zero"), F.posexplode(parts).alias("_at", "body")).select(id_col, (F.col("_at") + F.col("_zero")).cast("bigint").alias("section"), "body")


def boundaries(text: str, size: int) -> list[str]:
    """Chunks of size characters at most, cut at a blank line, else a line end, else a blank, if that leaves half a chunk; else hard."""
    out = []
    while len(text) > size:
        cut = next((k for sep in ("\n\n", "\n", " ") if (k := text.rfind(sep, 0, size)) >= size // 2), size)
        out.append(text[:cut].strip())
        text = text[cut:].lstrip()
    return [x for x in (*out, text.strip()) if x]


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, place, chunk) of each text; null and blank texts have none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, c) for i, text in zip(batch[id_col], batch[text_col], strict=True) if text for k, c in enumerate(boundaries(text, size))]
            yield pd.DataFrame(rows, columns=[id_col, "place", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(split, f"{id_col} {kind}, place long, chunk string")


def profile_sentences(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, sentence): "key: value" for each key of a JSON object; values that are lists or objects stay JSON."""
    pairs = F.map_entries(F.from_json(json_col, "map<string,string>"))
    return docs.select(id_col, F.explode(pairs).alias("p")).where("p.value IS NOT NULL AND p.value NOT IN ('', '[]', '{}')").select(id_col, F.concat(F.regexp_replace("p.key", "_", " "), F.lit(": "), "p.value").alias("sentence"))


def contexts(messages: DataFrame, key: str, order: str, time: str, total: int | None = None, most: int = 400_000, small: int = 500, head: int = 12_000, tail: int = 4_000) -> DataFrame:
    """(key, place, context): the dialogues of messages (key, order, time, role, text) in pieces that a model takes.

    A dialogue of at most so many characters is one piece. A longer one is a piece for each session (a gap of four hours ends one), cut in
    the middle where it is too long; where all there is, total conversations, are fewer than small, it is one piece, cut. Only people's and
    assistants' messages with a text count, but all of them make sessions.
    """
    placed = sessions(messages.select(key, order, time, "role", "text"), key, time, order)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text")
    lines = placed.where(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select(key, "session", F.struct(time, order, line.alias("line")).alias("_line"))
    parts = lines.groupBy(key, "session").agg(F.array_join(F.array_sort(F.collect_list("_line"))["line"], "\n\n").alias("d"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("session", "d"))).alias("_all")).withColumn("_d", F.array_join("_all.d", "\n\n"))
    shortened = lambda c: F.when(F.length(c) > most, head_tail(c, head, tail)).otherwise(c)
    each = F.array(shortened(F.col("_d"))) if total is not None and total < small else F.transform(F.col("_all.d"), shortened)
    return whole.select(key, F.posexplode(F.when(F.length("_d") <= most, F.array("_d")).otherwise(each)).alias("place", "context")).withColumn("place", F.col("place").cast("long"))

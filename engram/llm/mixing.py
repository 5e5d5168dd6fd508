"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256


def _hashed(text: Column) -> Column:
    """A long from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """Targets of sources from rows (source_key, source_size), one row each: adds target.

    Sources in key order take the weights in turn and share the whole size by them. A target stops at max_repeat times
    its source's size; the excess goes to the rest by weight until none is above. In closed form: with sources in order
    of size per weight, the first k are full, for the smallest k at which the next isn't.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights) + 1)
    by_ratio = Window.orderBy("ratio", "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("full", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("free", F.col("level") <= F.col("ratio"))
        .withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return ranked.select("source_key", "source_size", F.least("full", F.coalesce(F.col("weight") * F.col("level"), F.col("full"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of docs with mix_size, mix_source_size, mix_target and mix_copies.

    Each document is expected target / source_size times. Along each source's documents, in order of size, the
    expected copies are summed, one random offset (of seed and source) is added, and the document is taken once for
    each integer passed. As documents stand in order of size, the words taken differ from the target by about one long
    document at most. The running sum takes three levels (size class, salt, rows), so that no source, however
    large, has to be in one task. Only the sums of sources, a row each, meet in one task.

    Null text: size 0. Null source: a source of its own, last. Empty table: empty. Repeated rows: each is a document.
    Columns of docs keep their names and values; those named mix_* and _mix_* are replaced.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digits = F.length(F.bin("mix_size"))
    rows = (
        docs.withColumn("mix_size", size)
        .withColumn("_mix_source", F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))))
        .withColumn("_mix_class", digits * 16 + F.expr("shiftright(mix_size, greatest(length(bin(mix_size)) - 4, 0))").cast("int"))
        .withColumn("_mix_salt", (_hashed(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % SALTS).cast("int"))
    )
    keys = ["_mix_source", "_mix_class", "_mix_salt"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("mix_size").alias("words"))
    classes = cells.groupBy("_mix_source", "_mix_class").agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"))
    sources = classes.groupBy(F.col("_mix_source").alias("source_key")).agg(F.sum("class_words").alias("source_size"))
    targets = source_targets(sources, weights, max_repeat).withColumnRenamed("source_key", "_mix_source")
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    class_at = classes.select("_mix_source", "_mix_class", before("class_n", Window.partitionBy("_mix_source").orderBy("_mix_class")).alias("class_at"))
    cell_at = cells.select(*keys, before("n", Window.partitionBy("_mix_source", "_mix_class").orderBy("_mix_salt")).alias("cell_at"))
    starts = cell_at.join(class_at, ["_mix_source", "_mix_class"]).join(targets, "_mix_source")
    starts = starts.select(*keys, (F.col("class_at") + F.col("cell_at")).alias("_mix_at"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("mix_size", id_col)) + F.col("_mix_at")
    offset = _hashed(F.concat(F.lit(f"{seed}:"), F.col("_mix_source"))) / F.lit(2.0**32)
    each = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    return (
        rows.join(starts, keys)
        .withColumn("_mix_place", place)
        .withColumn("mix_copies", (F.floor(offset + each * F.col("_mix_place")) - F.floor(offset + each * (F.col("_mix_place") - 1))).cast("long"))
        .drop(*keys, "_mix_at", "_mix_place")
    )

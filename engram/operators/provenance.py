"""Provenance from the artifacts that thoughts point to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import uuids

#: Fixed value: a reference by number, which names no thought here.
NUMBER_REF = r"#\d{1,18}\b"


def provenance_backfill(thoughts: DataFrame, artifacts: DataFrame, suffixes: Sequence[str], force: bool = False) -> DataFrame:
    """thoughts (id, source_type, derivation_layer, derived_from, artifact_path) after the backfill, with derivation_method and reason.

    Those of a source_type that ends in one of suffixes become derived, unless they are already and force isn't given;
    the rest stay, with a null reason. The ids in the text of the artifact (path, text) are the parents. A text with references
    by number gives none, as do a missing path, file or id: derived_from stays then, and reason says which it was.
    """
    files = artifacts.groupBy(F.col("path").alias("artifact_path")).agg(F.max("text").alias("_text"), F.lit(True).alias("_there"))
    rows = thoughts.join(files, "artifact_path", "left")
    fits = reduce(lambda a, b: a | b, [F.col("source_type").endswith(x) for x in suffixes], F.lit(False))
    known = F.coalesce(F.col("derivation_layer") == "derived", F.lit(False))
    chosen = F.coalesce(fits, F.lit(False)) & (F.lit(force) | ~known)
    text = F.coalesce("_text", F.lit(""))
    bad, found = text.rlike(NUMBER_REF), uuids(text)
    reason = (
        F.when(~chosen, None).when(F.col("artifact_path").isNull(), "no artifact path").when(F.col("_there").isNull(), "artifact not found").when(bad, "parse error: references by number")
        .when(F.size(found) > 0, F.concat(F.lit("parsed "), F.size(found), F.lit(" parent ids"))).otherwise("artifact has no parent ids")
    )
    return rows.select(
        "id", "source_type", F.when(chosen, "derived").otherwise(F.col("derivation_layer")).alias("derivation_layer"), F.when(chosen, "synthesis").alias("derivation_method"),
        F.when(chosen & ~bad & (F.size(found) > 0), found).otherwise(F.col("derived_from")).alias("derived_from"), reason.alias("reason"),
    )

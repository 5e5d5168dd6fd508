"""Linting thoughts by a provider, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.models import Provider, answered
from engram.operators.summaries import in_batches

#: What a provider looks for.
CATEGORIES = ("contradictions", "stale_facts", "superseded", "orphans", "low_signal", "missing_links")
ASK = "Look for real problems among these thoughts. Answer with JSON: an object with an array for each of " + ", ".join(CATEGORIES) + '; its items are {"thought_ids": [..], "issue": "..", "suggested_action": ".."}.\nTHOUGHTS:\n'


def lint_batches(thoughts: DataFrame, provider: Provider, where: Column | None = None, batch: int = 20, shown: int = 400, retries: int = 2) -> DataFrame:
    """(batch, thought_ids, raw): thoughts of at least 20 characters, the latest ids first, in batches, and what the provider says of each.

    thoughts has id, content, type, importance, created_at and topics. The provider gets a prompt with the thoughts as JSON, of each the first
    characters and topics, and gives {"raw": its answer}; raw is null where it fails. No thought is left out and none is asked about twice.
    """
    rows = thoughts if where is None else thoughts.where(where)
    head = F.struct("id", F.date_format("created_at", "yyyy-MM-dd").alias("date"), "type", "importance", F.substring("content", 1, shown).alias("content"), F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 5).alias("topics"))
    some = rows.where(F.length(F.trim("content")) >= 20).select(F.lit(0).alias("_every"), (-F.col("id")).alias("_place"), F.lit(1).alias("_one"), F.to_json(head).alias("_head"))
    placed = in_batches(some, ["_every"], ["_place"], "_one", batch).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_place", "_head"))).alias("_rows"))
    asked = placed.select("batch", F.transform("_rows", lambda r: -r["_place"]).alias("thought_ids"), F.concat(F.lit(ASK + "["), F.array_join("_rows._head", ","), F.lit("]")).alias("_prompt"))
    return answered(asked, "_prompt", provider, "raw string", retries).select("batch", "thought_ids", "answer.raw")


def lint_findings(batches: DataFrame) -> DataFrame:
    """(batch, category, thought_ids, issue, suggested_action) of what lint_batches gives; answers may be fenced as code.

    Ids that aren't of the batch are dropped, and findings without ids or issue. An answer that is no JSON object is one row of the category
    unreadable, with the ids of the batch.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("raw", F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    rows = batches.select("batch", "thought_ids", F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text).alias("_json"))
    item = "array<struct<thought_ids: array<string>, issue: string, suggested_action: string>>"
    # each category by itself, so that a malformed one doesn't take the others with it
    of = lambda c: F.transform(F.from_json(F.get_json_object("_json", f"$.{c}"), item), lambda f: F.struct(F.lit(c).alias("category"), *[f[k].alias(k) for k in ("thought_ids", "issue", "suggested_action")]))
    none = F.array().cast(f"array<struct<category: string, {item[len('array<struct<') : -2]}>>")
    found = rows.where(F.col("_json").isNotNull()).select("batch", F.col("thought_ids").alias("_ids"), F.explode(F.flatten(F.array(*[F.coalesce(of(c), none) for c in CATEGORIES]))).alias("f"))
    known = F.array_distinct(F.filter(F.transform("f.thought_ids", lambda x: x.try_cast("bigint")), lambda x: F.array_contains(F.col("_ids"), x)))
    kept = found.select("batch", "f.category", known.alias("thought_ids"), F.trim("f.issue").alias("issue"), F.trim("f.suggested_action").alias("suggested_action")).where((F.size("thought_ids") > 0) & (F.col("issue") != ""))
    bad = rows.where(F.col("_json").isNull()).select("batch", F.lit("unreadable").alias("category"), "thought_ids", F.lit(None).cast("string").alias("issue"), F.lit(None).cast("string").alias("suggested_action"))
    return kept.unionByName(bad)

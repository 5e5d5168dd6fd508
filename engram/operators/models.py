"""Steps that call a model, as Spark operators that take a provider: a function of a list of texts that returns a dictionary for each.

The providers here need no model and always answer alike; callers bring their own, which runs in the tasks, a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.functions import text as X
from engram.functions.values import agreed_confidence, merged_maps
from engram.operators.batches import small
from engram.operators.capture import ANSWER, TYPES, sanitised, within

Provider = Callable[[list[str]], list[dict]]
#: What entities and relations may be.
ENTITY_TYPES = ("person", "project", "topic", "tool", "organization", "place")
RELATIONS = ("works_on", "uses", "related_to", "member_of", "located_in", "co_occurs_with")


def answered(rows: DataFrame, text_col: str, provider: Provider, schema: str, retries: int = 2) -> DataFrame:
    """rows with the provider's answers as the column answer. A batch that fails is tried again; then its answers are null."""
    names = StructType.fromDDL(schema).fieldNames()

    @F.pandas_udf(f"struct<{schema}>" if ":" in schema else StructType.fromDDL(schema))
    def call(texts: pd.Series) -> pd.DataFrame:
        asked = [t or "" for t in texts]
        for _ in range(retries + 1):
            try:
                found = provider(asked)
                break
            except Exception:  # noqa: BLE001  whatever a provider raises
                found = [{}] * len(asked)
        return pd.DataFrame([{k: a.get(k) for k in names} for a in found], columns=names)

    return small(rows).withColumn("answer", call(text_col))


def rule_metadata(text: Column) -> tuple[Column, Column]:
    """(type, topics) by rules, which is what is left when no model answers."""
    return X.fallback_type(text), X.fallback_topics(text, {"meeting": "meetings", "budget": "money", "travel": "travel"}, "general")


def classified_pairs(pairs: DataFrame, provider: Provider, least: float = 0.5) -> DataFrame:
    """Pairs (a, b, text): all are asked for a relation; unknown relations and weak answers go."""
    out = answered(pairs.select("a", "b", "text"), "text", provider, "relation string, confidence double")
    return out.select("a", "b", "answer.relation", "answer.confidence").where(F.col("relation").isin(*RELATIONS) & (F.col("confidence") >= least))


def atoms(rows: DataFrame, id_col: str, text_col: str, provider: Provider | None = None, least: int = 1) -> DataFrame:
    """(id, place, atom): compound texts by sentence, others whole. Null texts have none.

    A provider is asked about compound texts and gives {"atoms": [..]}; blank atoms don't count, and a text for which it gives fewer than least,
    or fails, goes by sentence.
    """
    trimmed = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    some = rows.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"), X.is_compound(F.col(text_col)).alias("_compound"))
    parts = trimmed(F.split("_text", r"(?<=[.!?])\s+"))
    if provider is not None:
        some = answered(some.withColumn("_asked", F.when(F.col("_compound"), F.col("_text"))), "_asked", lambda texts: asked_only(texts, provider), "atoms array<string>")
        said = trimmed(F.col("answer.atoms"))
        parts = F.when(F.size(said) >= max(1, least), said).otherwise(parts)
    found = some.select(id_col, F.posexplode(F.when(F.col("_compound"), parts).otherwise(F.array("_text"))).alias("place", "atom"))
    return found.withColumn("place", F.col("place").cast("bigint"))


def group_summaries(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], text_col: str, most: int = 20, chars: int = 160) -> DataFrame:
    """(keys, items, summary): the first lines of a group's first rows. Only those rows are gathered."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = rows.withColumn("_n", n).where(F.col("_n") <= most)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("items"))
    lines = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", F.substring(X.collapsed(F.col(text_col)), 1, chars).alias("line")))).alias("all"))
    return counts.join(lines, list(keys)).select(*keys, "items", F.array_join("all.line", "\n").alias("summary"))


def findings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, category, severity) of problems that rules find in texts."""
    checks = [("secret", "high", X.secret_label(F.col(text_col)).isNotNull()), ("personal", "medium", X.sensitivity(F.col(text_col))[0] != "standard"), ("compound", "low", X.is_compound(F.col(text_col))), ("long", "low", F.length(text_col) > 5000)]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("category"), F.lit(s).alias("severity"))) for n, s, c in checks]))
    return rows.select(id_col, F.explode(found).alias("f")).select(id_col, "f.*")


def routes(rows: DataFrame, kind: Column, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows once for each table that takes their kind, as the column destination. A sink writes each destination's rows by itself."""
    taken = F.array_compact(F.array(*[F.when(kind.isin(*kinds), F.lit(name)) for name, kinds in tables.items()]))
    return rows.withColumn("destination", F.explode(F.when(F.size(taken) > 0, taken).otherwise(F.array(F.lit("thoughts")))))


def keyword_relations(texts: list[str]) -> list[dict]:
    """A provider for pairs: by words in their texts."""
    out = []
    for t in texts:
        uses = len(re.findall(r"\b(use|uses|using|with|avec|mit)\b", t.lower()))
        out.append({"relation": "uses" if uses else "related_to", "confidence": min(1.0, 0.5 + uses / 10)})
    return out


def extracted_metadata(rows: DataFrame, text_col: str, providers: Sequence[Provider], retries: int = 2) -> DataFrame:
    """rows with metadata by the first of the providers that answers a text: type, summary, topics, tags, people, action_items,
    importance, confidence, within bounds, and enrichment_status, complete or fallback. A provider is asked only for what those before left.
    """
    out, answers = rows, []
    for k, provider in enumerate(providers):
        asked = F.when(F.col(text_col).isNotNull() & reduce(lambda a, c: a & c.isNull(), answers, F.lit(True)), F.col(text_col))
        out = answered(out.withColumn("_asked", asked), "_asked", lambda texts, ask=provider: asked_only(texts, ask), ANSWER, retries)
        heard = reduce(lambda a, c: a | c, [F.col(f"answer.{f}").isNotNull() for f in ("type", "summary", "confidence")])
        out = out.withColumn(f"_heard{k}", F.when(heard & F.col("_asked").isNotNull(), F.col("answer"))).drop("answer", "_asked")
        answers.append(F.col(f"_heard{k}"))
    answer = F.coalesce(*answers, F.lit(None).cast(StructType.fromDDL(ANSWER)))
    parts = sanitised(answer, F.col(text_col))
    return out.select(*rows.columns, *[c.alias(k) for k, c in parts.items()], F.when(answer.isNotNull(), "complete").otherwise("fallback").alias("enrichment_status"))


def asked_only(texts: list[str], provider: Provider) -> list[dict]:
    """A provider's answers to the texts that aren't empty, and nothing for the others."""
    some = [t for t in texts if t]
    found = iter(provider(some) if some else [])
    return [next(found) if t else {} for t in texts]


def enriched(thoughts: DataFrame, providers: Sequence[Provider]) -> DataFrame:
    """thoughts (id, content, type, metadata as a map, importance) after enrichment: the answers' metadata over the stored, type and importance theirs.

    Where no provider answers, a thought stays as it is; enrichment_status says which.
    """
    found = extracted_metadata(thoughts.select("id", F.col("content").alias("_content")), "_content", providers)
    said = found.select("id", *[F.col(c).alias(f"_{c}") for c in ("type", "summary", "topics", "people", "importance", "confidence")], "enrichment_status")
    rows, done = thoughts.join(said, "id"), F.col("enrichment_status") == "complete"
    new = F.create_map(F.lit("type"), F.col("_type"), F.lit("summary"), F.col("_summary"), F.lit("topics"), F.to_json("_topics"), F.lit("people"), F.to_json("_people"), F.lit("confidence"), F.col("_confidence").cast("string"))
    others = [c for c in thoughts.columns if c not in ("type", "metadata", "importance")]
    return rows.select(*others, F.when(done, F.col("_type")).otherwise(F.col("type")).alias("type"), F.when(done, merged_maps(F.col("metadata"), new)).otherwise(F.col("metadata")).alias("metadata"), F.when(done, F.coalesce(F.col("_importance").cast("long"), "importance")).otherwise(F.col("importance")).alias("importance"), "enrichment_status")


def graded_chains(thoughts: DataFrame, provider: Provider, shown: int = 40) -> DataFrame:
    """(id, parents, existence, relevance, sufficiency, rationale, composite): how well a derived thought is borne out by its parents.

    The provider gets a prompt with the thought and up to 40 parents and gives {"raw": its answer}. The answer is JSON, or ends with an object
    of it; scores that aren't numbers from 0 to 5 make all of a grade null. Parents that aren't stored count as none.
    """
    flat = lambda c, n: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), 1, n)
    derived = thoughts.where(F.size("derived_from") > 0)
    wanted = derived.select("id", F.posexplode(F.slice("derived_from", 1, shown)).alias("_place", "_parent"))
    about = F.concat_ws(" ", F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("source:"), F.coalesce("source_type", F.lit(""))), F.concat(F.lit("type:"), F.coalesce("type", F.lit(""))), flat(F.col("content"), 280))
    lines = wanted.join(thoughts.select(F.col("id").alias("_parent"), about.alias("_line")), "_parent").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_place", "_line"))).alias("_lines"))
    ask = F.concat(F.lit("Grade from 0 to 5 whether the parents exist, are relevant and suffice for the thought. Answer with JSON: existence, relevance, sufficiency, rationale.\nTHOUGHT: "), flat(F.col("content"), 600), F.lit("\nPARENTS:\n"), F.array_join("_lines._line", "\n"))
    asked = answered(derived.join(lines, "id").select("id", F.size("_lines").cast("long").alias("parents"), ask.alias("_prompt")), "_prompt", provider, "raw string")
    raw = F.trim("answer.raw")
    last = F.regexp_extract(raw, r"(\{[^{}]*\})[^{]*$", 1)
    scores = ("existence", "relevance", "sufficiency")
    form = ", ".join(f"{s} double" for s in scores) + ", rationale string"
    read = lambda c: F.from_json(c, form)
    graded = asked.withColumn("_g", F.when(raw.startswith("{") & F.from_json(raw, "map<string,string>").isNotNull(), read(raw)).otherwise(read(last)))
    ok = reduce(lambda a, c: a & c, [F.coalesce(F.col(f"_g.{s}").between(0, 5), F.lit(False)) for s in scores])
    mean = sum((F.col(f"_g.{s}") for s in scores), F.lit(0.0)) / 3
    return graded.select("id", "parents", *[F.when(ok, F.col(f"_g.{s}")).alias(s) for s in scores], F.when(ok, F.substring(F.coalesce("_g.rationale", F.lit("")), 1, 400)).alias("rationale"), F.when(ok, F.round(mean, 6)).alias("composite"))


def classified_captures(rows: DataFrame, text_col: str, provider: Provider, thresholds: DataFrame, hint: str | None = None, start: float = 0.75, sure: int = 9) -> DataFrame:
    """rows with type, confidence (0 to 10), threshold and auto, whether the type is taken without asking.

    Answers (type, confidence) with an unknown type are ideas. What is less sure than sure is asked a second time, and a type that differs
    then costs confidence. A hint, a column of types, goes before all answers. thresholds is (type, threshold); a type without one has start.
    """
    form, hinted = "type string, confidence double", F.col(hint) if hint else F.lit(None).cast("string")
    known = lambda c: F.when(c.isin(*TYPES), c).otherwise("idea")
    first = answered(rows, text_col, provider, form).withColumn("_type", known(F.col("answer.type"))).withColumn("_sure", F.floor(within(F.col("answer.confidence"), 0, 10, 7.0) + 0.5)).drop("answer")
    again = hinted.isNull() & (F.col("_sure") < sure)
    second = answered(first.withColumn("_again", F.when(again, F.col(text_col))), "_again", lambda texts: asked_only(texts, provider), form)
    agreed = F.when(again, agreed_confidence(F.col("_sure").cast("double"), F.col("_type"), known(F.col("answer.type")))).otherwise(F.col("_sure"))
    done = second.select(*rows.columns, F.coalesce(hinted, "_type").alias("type"), F.when(hinted.isNotNull(), 10).otherwise(agreed).cast("double").alias("confidence"), hinted.isNotNull().alias("_hinted"))
    out = done.join(thresholds.select("type", "threshold"), "type", "left").withColumn("threshold", F.coalesce("threshold", F.lit(start)))
    return out.select(*rows.columns, "type", "confidence", "threshold", (F.col("_hinted") | (F.col("confidence") / 10 >= F.col("threshold"))).alias("auto"))

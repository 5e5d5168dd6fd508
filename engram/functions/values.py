"""Functions of times, scores and arrays, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of timestamps, the first that fits counts.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
#: Layers of the operating model in their order.
LAYERS = ["operating_rhythms", "recurring_decisions", "dependencies", "institutional_knowledge", "friction"]
#: Parts of the recall score.
PROVENANCE_SCORE = {"user_confirmed": 0.3, "imported": 0.22, "observed": 0.15, "generated": 0.05}
REVIEW_SCORE = {"confirmed": 0.15, "evidence_only": 0.05, "pending": -0.08}


def of_map(value: Column, scores: Mapping[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in scores.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def any_time(text: Column, formats: Sequence[str] = tuple(TIME_FORMATS)) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def extended_json_time(document: Column, path: str = "$.date") -> Column:
    """{"$date": "..."}, {"$date": {"$numberLong": "..."}} or a plain string."""
    millis = F.get_json_object(document, f"{path}['$date']['$numberLong']").try_cast("bigint")
    return F.coalesce(F.timestamp_millis(millis).cast("timestamp_ntz"), any_time(F.regexp_replace(F.get_json_object(document, f"{path}['$date']"), "Z$", "")), any_time(F.get_json_object(document, path)))


def life_date(metadata: Column, keys: Sequence[str], fallback: Column) -> Column:
    """The first key of a JSON object with a date of ten characters or more, else the fallback."""
    each = [F.get_json_object(metadata, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(F.length(e) >= 10, F.try_to_timestamp(F.substring(e, 1, 10), F.lit("yyyy-MM-dd"))).cast("timestamp_ntz") for e in each], fallback)


def age_days(at: Column, as_of: str) -> Column:
    seconds = F.timestamp_diff("SECOND", at, F.lit(as_of).cast("timestamp_ntz"))
    return F.greatest(seconds / 86400.0, F.lit(0.0))


def recency_blend(similarity: Column, age: Column, weight: float = 0.0, scale_days: float = 90.0) -> Column:
    """similarity (1 - w) + exp(-age / scale) w, with w from 0 to 1 and the scale at least a day."""
    w, h = max(0.0, min(1.0, weight)), max(1.0, scale_days)
    return similarity * F.lit(1.0 - w) + F.exp(-age / F.lit(h)) * F.lit(w)


def guarded_number(text: Column, low: float, high: float, default: float) -> Column:
    """A number in a string, rounded and kept within bounds; the default if it isn't one."""
    ok = text.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), F.round(text.try_cast("double"))))).otherwise(F.lit(default))


def recall_score(similarity: Column) -> Column:
    policy = F.when(F.col("can_use_as_instruction"), 0.2).when(F.col("can_use_as_evidence"), 0.08).otherwise(-0.2)
    return similarity + of_map(F.col("provenance_status"), PROVENANCE_SCORE, 0.0) + policy + of_map(F.col("review_status"), REVIEW_SCORE, -0.25) + F.coalesce("confidence", F.lit(0.0)) * 0.15


def agreed_confidence(confidence: Column, first: Column, second: Column) -> Column:
    return F.when(first != second, F.round(confidence * 0.6)).otherwise(confidence)


def next_layer(done: Column) -> Column:
    left = F.array_except(F.array(*map(F.lit, LAYERS)), F.coalesce(done, F.array().cast("array<string>")))
    return F.coalesce(F.try_element_at(left, F.lit(1)), F.lit("review"))


def merged_list(a: Column, b: Column, size: int = 12) -> Column:
    """Distinct, in order, so many at most."""
    return F.slice(F.array_distinct(F.concat(a, b)), 1, size)


def merged_maps(old: Column, new: Column) -> Column:
    """Keys of both; where both have one, the new one's value. Null is empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def chat_cost(prompt: Column, answer: Column, model: Column, prices: Mapping[str, tuple[float, float]]) -> Column:
    """Cost in units of the prices, which are for a million tokens of prompt and of answer."""
    return (prompt * of_map(model, {k: p[0] for k, p in prices.items()}, 0.0) + answer * of_map(model, {k: p[1] for k, p in prices.items()}, 0.0)) / 1_000_000

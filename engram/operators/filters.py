"""Filters and lists over a memory store: each takes a DataFrame and returns one, with the clock as a parameter."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a list may be sorted by.
SORTABLE = ("created_at", "importance", "quality_score", "type", "id")


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return max(low, min(high, default if value is None else value))


def since(column: Column, as_of: str, days: int | None) -> Column:
    """Whether a time is within so many days before the clock; without days, always."""
    return F.lit(True) if days is None else column >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def newest(df: DataFrame, limit: int, time: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(limit)


def list_thoughts(thoughts: DataFrame, as_of: str, limit: int = 10, kind: str | None = None, topic: str | None = None, person: str | None = None, days: int | None = None) -> DataFrame:
    """The newest thoughts of a type, topic and person within some days. Null types, topics and people match no filter."""
    out = thoughts
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if topic is not None:
        out = out.where(F.array_contains("topics", topic))
    if person is not None:
        out = out.where(F.array_contains("people", person))
    return newest(out.where(since(F.col("created_at"), as_of, days)), limit)


def page_thoughts(
    thoughts: DataFrame, kind: str | None = None, source: str | None = None, statuses: Sequence[str] = (), importance_min: int | None = None, quality_max: int | None = None,
    exclude_restricted: bool = True, sort: str = "created_at", descending: bool = True, page: int = 1, per_page: int = 20,
) -> DataFrame:
    """A page of the thoughts that pass all filters, nulls last, with the id as the last key. Unknown sort columns become created_at."""
    out = thoughts
    for name, value in (("type", kind), ("source_type", source)):
        out = out if value is None else out.where(F.col(name) == value)
    out = out.where(F.col("status").isin(*statuses)) if statuses else out
    out = out if importance_min is None else out.where(F.col("importance") >= importance_min)
    out = out if quality_max is None else out.where(F.col("quality_score") <= quality_max)
    out = out.where(not_restricted("neq")) if exclude_restricted else out
    by = sort if sort in SORTABLE else "created_at"
    per_page = clamp(per_page, 1, 100, 20)
    return out.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), F.desc("id") if descending else F.asc("id")).offset((max(page, 1) - 1) * per_page).limit(per_page)


def not_restricted(how: str = "distinct", tier: str = "sensitivity_tier") -> Column:
    """neq drops null tiers; distinct keeps them; or_metadata also looks into the metadata's own tier."""
    column = F.col(tier)
    if how == "neq":
        return column != "restricted"
    keep = ~column.eqNullSafe(F.lit("restricted"))
    if how == "or_metadata":
        keep &= ~F.get_json_object("metadata", "$.sensitivity_tier").eqNullSafe(F.lit("restricted"))
    return keep


def tier_not_in(tiers: Sequence[str], tier: str = "sensitivity_tier") -> Column:
    return F.col(tier).isNull() | ~F.col(tier).isin(*tiers)


def contains_json(column: Column, wanted: Mapping, path: str = "$") -> Column:
    """Whether a JSON object has all that wanted has: scalars by value, arrays as sets, objects key by key."""
    parts = [F.lit(True)]
    for key, value in wanted.items():
        at = f"{path}.{key}"
        if isinstance(value, Mapping):
            parts.append(contains_json(column, value, at))
        elif isinstance(value, (list, tuple)):
            kind = "array<map<string,string>>" if value and isinstance(value[0], Mapping) else "array<string>"
            items = F.from_json(F.get_json_object(column, at), kind)
            for v in value:
                if isinstance(v, Mapping):
                    fits = lambda x, v=v: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(str(y)).alias("v")) for k, y in v.items()]), lambda p: x[p["k"]] == p["v"])
                    parts.append(F.exists(items, fits))
                else:
                    parts.append(F.array_contains(items, v if isinstance(v, str) else json.dumps(v)))
        else:
            parts.append(F.get_json_object(column, at) == (value if isinstance(value, str) else json.dumps(value)))
    out = parts[0]
    for p in parts[1:]:
        out &= F.coalesce(p, F.lit(False))
    return out


def has_all(column: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), column)) == 0


def any_like(columns: Sequence[str], text: str) -> Column:
    """Whether one of the columns has the text, in any case."""
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def due_split(due: Column, today: str) -> Column:
    return F.when(due < F.to_date(F.lit(today)), "overdue").otherwise("upcoming")


def overlaps(start: Column, end: Column, first: str, last: str, recurring: Column) -> Column:
    """Whether an interval, open if its end is null, meets [first, last], or recurs."""
    a, b = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    return ((start <= b) & (end.isNull() | (end >= a))) | recurring


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Whether something holds at a time: null ends are open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def violations(checks: Mapping[str, Column]) -> Column:
    """Names of the constraints that a row breaks. As in SQL, one that is null isn't broken."""
    return F.array_compact(F.array(*[F.when(~check, F.lit(name)) for name, check in checks.items()]))


def scope_matches(workspace: str, project: str | None, include_stale: bool = False, include_unconfirmed: bool = False, personal: bool = False, project_only: bool = False) -> Column:
    """Which memories a request may see."""
    out = F.col("workspace_id") == workspace
    if project_only and project is not None:
        out &= F.col("project_id") == project
    if not include_stale:
        out &= ~F.col("lifecycle_status").isin("stale", "superseded", "rejected", "disputed")
    if not include_unconfirmed:
        out &= ~(F.col("requires_user_confirmation") & (F.col("review_status") == "pending"))
    return out if personal else out & (F.col("visibility") != "personal")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def conversation_skip(messages: Column, words: Column, title: Column, do_not_remember: Column, min_messages: int = 2, always: int = 10, min_words: int = 20) -> Column:
    """Why a conversation isn't taken: single_turn, do_not_remember, untitled_short, too_little_text; null if it is."""
    short = messages < always
    return first_reason([
        ("do_not_remember", do_not_remember),
        ("single_turn", messages < min_messages),
        ("untitled_short", short & (F.coalesce(title, F.lit("")) == "") & (messages <= 5)),
        ("too_little_text", short & (words < min_words)),
    ])


#: Parts of senders and patterns of subjects and bodies of mail that machines write.
NOISE_SENDERS = ["no-reply", "noreply", "no.reply", "automated@", "donotreply", "notifications@", "mailer-daemon", "postmaster@"]
NOISE_SUBJECTS = [
    r"\b(receipt|invoice|payment|autopay|billing)\b", r"\byour (order|booking|reservation|subscription)\b", r"\bconfirmation #", r"\bbooking #", r"\bpassword reset\b",
    r"\bverify your (email|account)\b", r"\bpayment (is )?due\b", r"\bpayment failed\b", r"\brequests? \$[\d,.]+",
]
NOISE_BODIES = ["reacted via gmail", "this message was automatically generated"]


def auto_generated(subject: Column, sender: Column, auto_header: Column, body: Column) -> Column:
    """Whether a mail was written by a machine. Null parts count as empty."""
    subject, sender, auto, body = (F.lower(F.coalesce(c, F.lit(""))) for c in (subject, sender, auto_header, body))
    out = ((auto != "") & (auto != "no")) | (subject == "unsubscribe") | (F.regexp_count(body, F.lit(r"\{[^}]*\}")) > 10)
    for text in NOISE_BODIES:
        out |= F.contains(body, F.lit(text))
    for text in NOISE_SENDERS:
        out |= F.contains(sender, F.lit(text))
    for pattern in NOISE_SUBJECTS:
        out |= subject.rlike(pattern)
    return out


def keeps_activity(title: Column, category: Column) -> Column:
    """Whether an entry of an activity log says enough: by length and, for maps, videos and the browser, by how it starts."""
    starts = lambda *xs: F.lit(False) if not xs else title.rlike("^(" + "|".join(xs) + ")")
    maps = (category == "Maps") & (starts("Visited ", "Viewed ", "Used maps", "Opened ") | (~starts("Searched for", "Direction", "Navigat") & (F.length(title) < 30)))
    video = (category == "YouTube") & ((starts("Watched ") & (F.length(title) < 40)) | starts("Visited "))
    browser = (category == "Chrome") & (F.length(title) < 15)
    return F.coalesce((F.length(title) >= 10) & ~title.rlike(r"^\d+ notification") & ~maps & ~video & ~browser, F.lit(False))

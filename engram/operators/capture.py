"""What becomes of a captured text: metadata within bounds, the payload to store, and the stored rows after writes and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions.values import merged_maps
from engram.operators.cut import cut
from engram.operators.upsert import latest

#: The type of a highlight's event, and what stands between a highlight and its note.
HIGHLIGHT, NOTE = "readwise.highlight.created", "\n\n— "

#: Types of thoughts.
TYPES = ("idea", "task", "person_note", "reference", "decision", "lesson", "meeting", "journal")
#: What holds where nobody says otherwise, and what a structured capture says.
DEFAULTS = {"type": "idea", "importance": 3, "confidence": 0.55}
STRUCTURED_SAYS = {"importance": 4, "confidence": 0.82}
#: Sizes of summaries, lists and of a text that ought to be divided.
SUMMARY, LISTS, OVERSIZED = 160, 12, 30_000
#: The parts of an answer, as sanitised takes and gives them.
ANSWER = "type string, summary string, topics array<string>, tags array<string>, people array<string>, action_items array<string>, importance double, confidence double"
#: What enhanced_upsert keeps beside content and metadata.
COLUMNS = ("type", "source_type", "importance", "quality_score", "sensitivity_tier")


def clean_list(items: Column) -> Column:
    """Trimmed, without blanks, the first twelve, each once. Null is empty."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.slice(kept, 1, LISTS))


def within(value: Column, low: float, high: float, otherwise: Column | float | None) -> Column:
    """value within bounds; otherwise, if it is null or no number."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, otherwise if isinstance(otherwise, Column) else F.lit(otherwise)).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def sanitised(answer: Column, text: Column) -> dict[str, Column]:
    """The parts of an answer (a struct of ANSWER) within bounds: known types, summaries and lists of bounded size, importance up to 5.

    A null answer gives what is known without one: an idea, the text's start, confidence 0.2.
    """
    start = F.substring(text, 1, SUMMARY)
    summary = F.substring(F.trim(answer["summary"]), 1, SUMMARY)
    return {
        "type": F.when(answer["type"].isin(*TYPES), answer["type"]).otherwise(DEFAULTS["type"]), "summary": F.coalesce(F.nullif(summary, F.lit("")), start),
        **{k: clean_list(answer[k]) for k in ("topics", "tags", "people", "action_items")},
        "importance": F.floor(within(answer["importance"], 0, 5, None) + 0.5), "confidence": within(answer["confidence"], 0, 1, 0.2),
    }


def prepared_payload(rows: DataFrame, text: str, caller: str, answer: str) -> DataFrame:
    """rows with the payload of their texts: content, type, summary, topics, tags, people, action_items, importance, confidence,
    quality_score, sensitivity_tier, capture_format, oversized, enrichment_status, warnings, content_fingerprint.

    caller is a struct of ANSWER with quality_score and sensitivity_tier besides, answer a struct of ANSWER; both may be null.
    The type is the structured capture's, else the caller's, else the answer's; all else is the caller's first. Lists of the caller
    replace those of the answer, and a capture's topic and next step are added. A tier is only raised. Blank texts go.
    """
    found = X.structured_capture(F.col(text))
    found["normalized"] = F.trim(found["normalized"])
    # exploded, as the filter would find the parts again, and each use of a part would too
    rows = rows.withColumn("_found", F.struct(*[c.alias(f"_{k}") for k, c in found.items()]))
    rows = rows.select("*", F.inline(F.array("_found")), F.col(caller).alias("_by"), F.col(answer).alias("_of")).where("_normalized <> ''")
    said = sanitised(F.col("_of"), F.col("_normalized"))
    heard, by = F.col("_of").isNotNull(), F.col("_by")
    given = lambda name: F.nullif(by[name], F.lit(""))
    wanted = F.lower(F.trim(F.coalesce(F.nullif(F.col("_kind"), F.lit("")), given("type"), F.when(heard, said["type"]), F.lit(DEFAULTS["type"]))))
    lists = {k: clean_list(by[k]) for k in ("topics", "tags", "people", "action_items")}
    lists = {k: F.when(F.size(c) > 0, c).when(heard, said[k]).otherwise(F.array().cast("array<string>")) for k, c in lists.items()}
    added = {"topics": F.col("_topic"), "tags": F.col("_topic"), "action_items": F.col("_next_step")}
    for k, c in added.items():
        lists[k] = F.when(c.isNotNull(), clean_list(F.array_append(lists[k], c))).otherwise(lists[k])
    lists["tags"] = X.with_evergreen(F.col("_normalized"), lists["tags"])
    captured = lambda name: F.when(F.col("_matched"), F.lit(STRUCTURED_SAYS[name]).cast("double"))
    importance = F.coalesce(F.floor(within(by["importance"], 0, 6, None) + 0.5), captured("importance"), F.when(heard, said["importance"]), F.lit(DEFAULTS["importance"]))
    confidence = F.coalesce(within(by["confidence"], 0, 1, None), captured("confidence"), F.when(heard, said["confidence"]), F.lit(DEFAULTS["confidence"]))
    quality = F.coalesce(within(by["quality_score"], 0, 100, None), F.floor(confidence * 70 + 20.5))
    oversized = F.length("_normalized") > OVERSIZED
    warnings = F.array_compact(F.array(F.when(oversized, F.lit("oversized_content")), F.when(~heard, F.lit("metadata_fallback"))))
    summary = F.substring(F.trim(F.coalesce(given("summary"), F.when(heard, F.nullif(said["summary"], F.lit(""))), F.col("_normalized"))), 1, SUMMARY)
    out = {
        "content": F.col("_normalized"), "type": F.when(wanted.isin(*TYPES), wanted).otherwise(DEFAULTS["type"]), "summary": summary, **lists, "importance": importance.cast("long"), "confidence": confidence,
        "quality_score": quality, "sensitivity_tier": X.resolved_tier(X.sensitivity(F.col("_normalized"))[0], given("sensitivity_tier")), "capture_format": F.when(F.col("_matched"), "structured_v1").otherwise("freeform"),
        "oversized": oversized, "enrichment_status": F.when(heard, "complete").otherwise("fallback"), "warnings": warnings, "content_fingerprint": X.fingerprint(F.col("_normalized")),
    }
    kept = [c for c in rows.columns if not c.startswith("_") and c not in out]
    return rows.select(*kept, *[c.alias(k) for k, c in out.items()])


def derived_columns(metadata: Column, status: Column) -> dict[str, Column]:
    """The columns that a write has by its metadata (a map), with their defaults; new tasks and ideas are new."""
    of = lambda k: F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    number = lambda k: F.when(of(k).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.least(F.lit(100.0), of(k).try_cast("double")))
    kind = F.coalesce(of("type"), F.lit("observation"))
    said = F.coalesce(F.nullif(status, F.lit("")), of("status"))
    return {
        "type": kind, "source_type": F.coalesce(of("source_type"), of("source"), F.lit("unknown")), "importance": F.coalesce(F.floor(number("importance") + 0.5).cast("long"), F.lit(50).cast("long")),
        "quality_score": F.coalesce(number("quality_score"), F.lit(70.0)), "sensitivity_tier": F.coalesce(of("sensitivity_tier"), F.lit("standard")),
        "status": F.coalesce(said, F.when(kind.isin("task", "idea"), "new")),
    }


def enhanced_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Thoughts (fingerprint, content, metadata, COLUMNS, status, status_updated_at) after writes (seq, content, metadata, status, at).

    Rows are those of a fingerprint of the content; writes without content go. Metadata merges key by key, columns are the last write's, a status stays where a
    write has none, and status_updated_at is the time of the last write whose status wasn't the one stored then, a missing one included.
    All but that time are aggregates that combine before the shuffle; the statuses, and nothing else, are looked at in order.
    """
    new = incoming.where("content IS NOT NULL").select(X.fingerprint(F.col("content")).alias("fingerprint"), F.col("seq").cast("long").alias("seq"), "content", "metadata", *[c.alias(k) for k, c in derived_columns(F.col("metadata"), F.col("status")).items()], F.col("at").alias("status_updated_at"))
    rows = existing.select("fingerprint", F.lit(None).cast("long").alias("seq"), *new.columns[2:]).unionByName(new).withColumn("_order", F.struct(F.col("seq").isNotNull(), "seq"))
    last = [F.max_by(c, "_order").alias(c) for c in COLUMNS]
    merged = rows.groupBy("fingerprint").agg(F.min_by("content", "_order").alias("content"), *last, F.max_by("status", F.when(F.col("status").isNotNull(), F.col("_order"))).alias("status"))
    pairs = rows.select("fingerprint", "_order", F.explode("metadata").alias("_key", "_value")).groupBy("fingerprint", "_key").agg(F.max_by("_value", "_order").alias("_value"))
    metadata = pairs.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("metadata"))
    before = F.last("status", ignorenulls=True).over(Window.partitionBy("fingerprint").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1))
    moved = rows.select("fingerprint", "_order", "seq", "status", "status_updated_at").withColumn("_moved", F.col("seq").isNull() | ~F.col("status").eqNullSafe(before))
    at = moved.where("_moved").groupBy("fingerprint").agg(F.max_by("status_updated_at", "_order").alias("status_updated_at"))
    empty = F.create_map().cast("map<string,string>")
    joined = merged.join(metadata, "fingerprint", "left").join(at, "fingerprint", "left")
    return joined.select("fingerprint", "content", F.coalesce("metadata", empty).alias("metadata"), *COLUMNS, "status", "status_updated_at")


def patched(existing: DataFrame, patches: DataFrame) -> DataFrame:
    """existing (id, metadata, content, type, importance, quality_score, sensitivity_tier, status, status_updated_at) after patches
    (id, the same columns, at), one for each id; null leaves a column as it is. result: updated, kept, or missing for a patch without a row.

    Metadata merges key by key and follows a new type; a given status, the old one too, sets status_updated_at.
    """
    columns = ["content", "type", "importance", "quality_score", "sensitivity_tier", "status"]
    new = patches.select("id", F.col("metadata").alias("_metadata"), *[F.col(c).alias(f"_{c}") for c in columns], F.col("at").alias("_at"), F.lit(True).alias("_new"))
    rows = existing.withColumn("_old", F.lit(True)).join(new, "id", "full")
    done = F.col("_old") & F.col("_new")
    kind = F.when(F.col("_type").isNotNull(), F.create_map(F.lit("type"), F.col("_type")))
    metadata = F.when(done, merged_maps(merged_maps(F.col("metadata"), F.col("_metadata")), kind)).otherwise(F.col("metadata"))
    result = F.when(F.col("_old").isNull(), "missing").when(F.col("_new").isNull(), "kept").otherwise("updated")
    at = F.when(done & F.col("_status").isNotNull(), F.col("_at")).otherwise(F.col("status_updated_at"))
    return rows.select("id", metadata.alias("metadata"), *[F.when(done, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in columns], at.alias("status_updated_at"), result.alias("result"))


def merged_metadata(existing: DataFrame, changes: DataFrame, under: str | None = None) -> DataFrame:
    """existing (id, metadata) after changes (id, new), maps both, at the top or within the JSON object that the key under holds.

    result: updated, kept, or missing for a change whose id isn't stored. Of several changes of an id the caller decides before.
    """
    rows = existing.withColumn("_old", F.lit(True)).join(changes.select("id", "new", F.lit(True).alias("_new")), "id", "full")
    if under:
        held = F.from_json(F.try_element_at("metadata", F.lit(under)), "map<string,string>")
        pairs = F.array_sort(F.map_entries(merged_maps(held, F.col("new"))))
        change = F.create_map(F.lit(under), F.to_json(F.map_from_entries(pairs)))
    else:
        change = F.col("new")
    result = F.when(F.col("_old").isNull(), "missing").when(F.col("_new").isNull(), "kept").otherwise("updated")
    metadata = F.when(F.col("_old") & F.col("_new"), merged_maps(F.col("metadata"), change)).otherwise(F.col("metadata"))
    return rows.select("id", metadata.alias("metadata"), result.alias("result"))


def reatomised(thoughts: DataFrame, edges: DataFrame, links: DataFrame, atoms: Column, new_id: Column, least_words: int = 150) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(thoughts, edges, links) after long mails, "[Email ...] body", were replaced by their atoms.

    thoughts (id, content, other columns), edges (from_id, to_id, relation), links (thought_id, entity_id). atoms is an array of strings
    made from the column body, new_id the id of an atom, made from id and place. A mail with a body of fewer words or with one atom
    stays. An atom has the mail's other columns, its links and a prefix that counts; replies_to edges go to the first atom, the mail's
    other edges go with it. re_atomized_from names the mail.
    """
    prefix, body = X.mail_parts(F.col("content"))
    rows = thoughts.select("*", prefix.alias("_prefix"), body.alias("body"))
    rows = rows.withColumn("_atoms", F.when(F.col("_prefix").isNotNull() & (X.word_count(F.col("body")) >= least_words), atoms))
    rows = rows.withColumn("_n", F.when(F.size("_atoms") >= 2, F.size("_atoms")))
    others = [c for c in thoughts.columns if c not in ("id", "content")]
    kept = lambda c, is_split: F.when(F.col("_n").isNotNull() if is_split else F.col("_n").isNull(), F.col(c)).alias(c)
    # written, as five results need who is split, and only two of them the texts
    rows = cut(rows.select("id", *others, "_n", kept("content", False), kept("_prefix", True), kept("_atoms", True)))
    split = F.col("_n").isNotNull()
    old = rows.where(split)
    parts = old.select("id", *others, "_prefix", "_n", F.posexplode("_atoms").alias("place", "_atom"))
    tag = F.concat(F.regexp_replace("_prefix", r"\]$", ""), F.lit(" | atom "), F.col("place") + 1, F.lit(" of "), F.col("_n"), F.lit("] "), F.col("_atom"))
    fresh = parts.select(new_id.alias("id"), tag.alias("content"), *others, F.col("id").cast("long").alias("re_atomized_from"))
    after = rows.where(~split).select("id", "content", *others, F.lit(None).cast("long").alias("re_atomized_from")).unionByName(fresh)
    heads = old.select("id", F.lit(0).alias("place")).select("id", new_id.alias("_head"))
    turned = edges
    for end in ("from_id", "to_id"):
        moved = turned.join(heads.select(F.col("id").alias(end), "_head"), end, "left").where(F.col("_head").isNull() | (F.col("relation") == "replies_to"))
        turned = moved.select(*[F.coalesce("_head", end).alias(end) if c == end else F.col(c) for c in edges.columns])
    copies = old.select("id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("place")).select(F.col("id").alias("thought_id"), new_id.alias("_to"))
    relinked = links.join(copies, "thought_id", "left").select(*[F.coalesce("_to", "thought_id").alias(c) if c == "thought_id" else F.col(c) for c in links.columns])
    return after, turned, relinked


def highlight_captures(events: DataFrame, known: DataFrame, books: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """(new thoughts, books after) of webhook events (secret, event_type, id, book_id, text, note, highlighted_at).

    Events with another secret, of another type, or of a highlight that known (highlight_id) has or that came before are passed over.
    Books (book_id, title, author, num_highlights, last_highlight_at) count their new highlights; one that isn't known stays uncounted.
    """
    taken = events.where((F.col("secret") == secret) & (F.col("event_type") == HIGHLIGHT))
    taken = latest(taken, ["id"], [F.col(c) for c in ("highlighted_at", "text", "note", "book_id")])  # of several the earliest, then the first by its text
    new = taken.join(known.select(F.col("highlight_id").alias("id")), "id", "left_anti")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(NOTE), F.col("note"))).otherwise("")
    titles = books.select("book_id", F.col("title").alias("book_title"), F.col("author").alias("book_author"))
    thoughts = new.join(titles, "book_id", "left").select(F.col("id").alias("highlight_id"), "book_id", F.concat("text", note).alias("content"), F.lit("reference").alias("type"), F.lit("readwise").alias("source_type"), "book_title", "book_author", "highlighted_at")
    counts = new.groupBy("book_id").agg(F.count("*").alias("_n"), F.max("highlighted_at").alias("_last"))
    counted = books.join(counts, "book_id", "left")
    after = counted.select("book_id", "title", "author", (F.col("num_highlights") + F.coalesce("_n", F.lit(0))).alias("num_highlights"), F.greatest("last_highlight_at", "_last").alias("last_highlight_at"))
    return thoughts, after


def enqueued(queue: DataFrame, thoughts: DataFrame) -> DataFrame:
    """The queue (id, status, attempts, last_error, fp, queued_at) after writes of thoughts (id, fp, generated_by, at), one for each id.

    What a program made is passed over. A new thought, or one whose fp changed, is pending again, without attempts and errors.
    """
    new = thoughts.where("generated_by IS NULL").select("id", F.col("fp").alias("_fp"), F.col("at").alias("_at"), F.lit(True).alias("_new"))
    rows = queue.withColumn("_old", F.lit(True)).join(new, "id", "full")
    again = F.col("_new").isNotNull() & (F.col("_old").isNull() | ~F.col("fp").eqNullSafe(F.col("_fp")))
    pick = lambda new, old: F.when(again, new).otherwise(F.col(old)).alias(old)
    return rows.select("id", pick(F.lit("pending"), "status"), pick(F.lit(0), "attempts"), pick(F.lit(None), "last_error"), pick(F.col("_fp"), "fp"), pick(F.col("_at"), "queued_at"))


def claimed(queue: DataFrame, limit: int, worker: str) -> DataFrame:
    """The queue with the oldest pending items, so many at most, in processing by worker. What isn't pending can't be claimed."""
    oldest = queue.where("status = 'pending'").orderBy("queued_at", "id").limit(limit).select("id", F.lit(True).alias("_mine"))
    rows = queue.join(oldest, "id", "left")
    return rows.select(*[c for c in queue.columns if c not in ("status", "worker")], F.when(F.col("_mine"), "processing").otherwise(F.col("status")).alias("status"), F.when(F.col("_mine"), F.lit(worker)).alias("worker"))


def settled(queue: DataFrame, outcomes: DataFrame, most: int = 5) -> DataFrame:
    """A claimed queue after outcomes (id, outcome, error): complete, release (given back, no attempt counted), or error, which counts and in the end fails."""
    from engram.operators.upsert import next_queue_state

    rows = queue.join(outcomes.select("id", "outcome", "error"), "id", "left")
    mine = (F.col("status") == "processing") & F.col("outcome").isNotNull()
    wrong = mine & ~F.col("outcome").isin("complete", "release")
    status = F.when(mine, next_queue_state(F.col("status"), F.col("outcome"), F.col("attempts"), most)).otherwise(F.col("status"))
    kept = [c for c in queue.columns if c not in ("status", "attempts", "last_error", "worker")]
    back = F.when(mine & (status == "pending"), None).otherwise(F.col("worker"))
    return rows.select(*kept, status.alias("status"), (F.col("attempts") + F.when(wrong, 1).otherwise(0)).alias("attempts"), F.when(wrong, F.substring("error", 1, 500)).otherwise(F.col("last_error")).alias("last_error"), back.alias("worker"))

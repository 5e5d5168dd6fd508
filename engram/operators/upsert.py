"""Write operators as queries that return the merged state: Spark writes it where the caller wants it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import fingerprint
from engram.functions.values import merged_maps

#: Relations that have no direction.
SYMMETRIC = ("related_to", "co_occurs_with")


def upsert_edges(mentions: DataFrame, symmetric: bool = False, relations: Sequence[str] = ()) -> DataFrame:
    """One row (from_id, to_id, relation, support, confidence) for each edge: how often it was seen and the highest confidence.

    symmetric orders the ends of all edges, relations those of the named relations. Mentions with null ends go.
    """
    turn = F.lit(True) if symmetric else F.col("relation").isin(*relations) if relations else F.lit(False)
    a, b = F.when(turn, F.least("from_id", "to_id")).otherwise(F.col("from_id")), F.when(turn, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))
    rows = mentions.where("from_id IS NOT NULL AND to_id IS NOT NULL").select(a.alias("from_id"), b.alias("to_id"), "relation", "confidence")
    return rows.groupBy("from_id", "to_id", "relation").agg(F.count("*").alias("support"), F.max("confidence").alias("confidence"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, relation, support, confidence, valid_from, valid_until): sums of support, the highest confidence, the earliest start, and an open end if any is open."""
    until = F.when(F.max(F.col("valid_until").isNull()), None).otherwise(F.max("valid_until"))
    return rows.groupBy("from_id", "to_id", "relation").agg(F.sum("support").alias("support"), F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"), until.alias("valid_until"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def upsert_thoughts(existing: DataFrame, incoming: DataFrame, embedding: str | None = None) -> DataFrame:
    """Thoughts (content, metadata as a map, seq) by fingerprint of the content: (fingerprint, content, metadata, writes).

    New metadata goes over old, key by key in order of seq; the first content stays. embedding: "new" takes the last one
    that isn't null, "old" the first. Each key's last value is an aggregate of its own, so the writes of a fingerprint,
    however many, are summed before they move and never gathered.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rows = both.withColumn("fingerprint", fingerprint(F.col("content"))).withColumn("_order", F.struct("_new", "seq"))
    out = [F.min_by("content", "_order").alias("content"), F.count("*").alias("writes")]
    if embedding:
        at = F.when(F.col("embedding").isNotNull(), F.col("_order"))
        out.append((F.max_by if embedding == "new" else F.min_by)("embedding", at).alias("embedding"))
    values = rows.select("fingerprint", "_order", F.explode("metadata").alias("_key", "_value")).groupBy("fingerprint", "_key").agg(F.max_by("_value", "_order").alias("_value"))
    metadata = values.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("metadata"))
    merged = rows.groupBy("fingerprint").agg(*out).join(metadata, "fingerprint", "left")
    return merged.select("fingerprint", "content", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "writes", *(["embedding"] if embedding else []))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing, and of incoming one row for each key that existing doesn't have. Nulls in keys are values like others.

    Both sides meet in one sort by key and existing is read once: an anti join would make it twice, and a task would hold a sort of each side.
    """
    new = incoming.dropDuplicates(list(keys)).withColumn("_new", F.lit(True))
    both = existing.withColumn("_new", F.lit(False)).unionByName(new)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_new"))
    return both.withColumn("_nth", first).where("NOT _new OR _nth = 1").drop("_new", "_nth")


def replace_all(existing: DataFrame, incoming: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners that incoming has are replaced by its rows."""
    return existing.join(incoming.select(owner).distinct(), owner, "left_anti").unionByName(incoming)


def optimistic_update(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """existing (key, metadata, updated_at) after changes (key, new_metadata, new_at, if_unchanged_since): result says updated, stale or kept."""
    rows = existing.join(changes, key, "left")
    stale = F.col("if_unchanged_since").isNotNull() & (F.col("updated_at") > F.col("if_unchanged_since"))
    result = F.when(F.col("new_at").isNull(), "kept").when(stale, "stale").otherwise("updated")
    done = result == "updated"
    return rows.select(key, F.when(done, merged_maps(F.col("metadata"), F.col("new_metadata"))).otherwise(F.col("metadata")).alias("metadata"), F.when(done, F.col("new_at")).otherwise(F.col("updated_at")).alias("updated_at"), result.alias("result"))


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of new whose value isn't that of old, nulls compared as values; rows that old doesn't have count as changed."""
    before = old.select(key, F.col(value).alias("_before"), F.lit(True).alias("_known"))
    return new.join(before, key, "left").where(F.col("_known").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_known")


def next_queue_state(status: Column, outcome: Column, attempts: Column, most: int = 5) -> Column:
    """complete ends a job, release gives it back, an error retries it until it has failed so often."""
    return F.when(status != "processing", status).when(outcome == "complete", "complete").when(outcome == "release", "pending").when(attempts + 1 >= most, "failed").otherwise("pending")


def sync_plan(stored: DataFrame, seen: DataFrame, key: str, path: str, digest: str) -> DataFrame:
    """What a full sync does: (key, action) with insert, update, keep and delete. Rows are matched by key, else by path."""
    old = stored.select(F.col(key).alias("_key"), F.col(path).alias("_path"), F.col(digest).alias("_digest"))
    by_key = seen.join(old, F.col(key) == F.col("_key"), "left")
    rest = by_key.where("_key IS NULL").select(*seen.columns)
    by_path = rest.join(old.join(seen.select(F.col(key).alias("_key")), "_key", "left_anti"), F.col(path) == F.col("_path"), "left")
    known = by_key.where("_key IS NOT NULL").unionByName(by_path)
    action = F.when(F.col("_key").isNull(), "insert").when(F.col("_digest").eqNullSafe(F.col(digest)), "keep").otherwise("update")
    gone = old.join(known.where("_key IS NOT NULL").select("_key"), "_key", "left_anti")
    return known.select(key, action.alias("action")).unionByName(gone.select(F.col("_key").alias(key), F.lit("delete").alias("action")))


def payload_rows(payloads: DataFrame, kinds: Mapping[str, str], id_col: str = "id", prefixed: Mapping[str, str] | None = None) -> DataFrame:
    """Array columns as rows (id, memory_type, place, content); prefixed columns get their text before the content."""

    def rows_of(name: str, kind: str) -> Column:
        before = F.lit((prefixed or {}).get(name, ""))
        row = lambda x, i: F.named_struct(F.lit("memory_type"), F.lit(kind), F.lit("place"), i.cast("bigint"), F.lit("content"), F.concat(before, x))
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), row)

    parts = [rows_of(name, kind) for name, kind in kinds.items()]
    return payloads.select(id_col, F.explode(F.concat(*parts)).alias("row")).select(id_col, "row.*")


def resolved_people(people: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities (entity_id, name, email) after addresses (name, email) were seen: (entity_id, name, email, how).

    An address that an entity has upgrades a bare name; a name that an entity without address has adopts it; if another
    address has the name, the new one is told apart by the part before its @; the rest are new. New ones have null ids.
    """
    from engram.functions.text import best_name, entity_name

    people = people.withColumn("_key", entity_name(F.col("name")))
    fresh = seen.where("email IS NOT NULL").select(F.lower(F.trim("email")).alias("email"), F.col("name").alias("_name")).groupBy("email").agg(F.max("_name").alias("_name"))
    known = people.join(fresh, "email", "left")
    upgraded = F.col("_name").isNotNull() & ~best_name(F.col("name"), F.col("_name"), F.col("email")).eqNullSafe(F.col("name"))
    kept = known.select("entity_id", best_name(F.col("name"), F.col("_name"), F.col("email")).alias("name"), "email", F.when(upgraded, "upgraded").otherwise("kept").alias("how"), "_key")
    new = fresh.join(people.where("email IS NOT NULL").select("email"), "email", "left_anti").withColumn("_key", entity_name(F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("email"))))
    first = latest(new, ["_key"], [F.col("email")])
    owners = people.groupBy("_key").agg(F.min(F.when(F.col("email").isNull(), F.col("entity_id"))).alias("_orphan"), F.count("*").alias("_n"))
    placed = new.join(first.select("email", F.lit(True).alias("_first")), "email", "left").join(owners, "_key", "left")
    adopted = F.col("_orphan").isNotNull() & F.col("_first").isNotNull()
    clash = ~adopted & (F.col("_n").isNotNull() | F.col("_first").isNull())
    name = F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("email"))
    local = F.substring_index("email", "@", 1)
    added = placed.select(F.when(adopted, F.col("_orphan")).alias("entity_id"), F.when(clash, F.concat(name, F.lit(" ("), local, F.lit(")"))).otherwise(name).alias("name"), "email", F.when(adopted, "adopted").when(clash, "disambiguated").otherwise("new").alias("how"))
    return kept.join(added.where("how = 'adopted'").select("entity_id"), "entity_id", "left_anti").drop("_key").unionByName(added)

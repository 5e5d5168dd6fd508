"""Sessions in which a profile is built layer by layer: the tables after a call, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.values import LAYERS, next_layer
from engram.operators.upsert import latest

#: The states of a session that is still open.
OPEN = ("in_progress", "review_ready")


def _place(layer: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), layer)


def _by_layer(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The checkpoints of a key as one array in the layers' order: a few, as there is one for each layer."""
    row = F.struct(_place(F.col("layer")).alias("at"), "layer", "version", "summary")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("at")).alias(name))


def start_sessions(profiles: DataFrame, sessions: DataFrame, checkpoints: DataFrame, users: DataFrame) -> DataFrame:
    """What each of users (user_id) gets when a session is asked for: the open one, or a new one of the next version.

    profiles (user_id, status, current_version), sessions (session_id, user_id, version, status, current_layer, completed_layers,
    created_at), checkpoints (session_id, user_id, layer, version, status, summary, approved_at). The newest open session
    counts. A new one has a null session_id, the version after the profile's and the first layer, and makes the profile
    a draft; a user without a profile starts at version 0. session_checkpoints are the approved ones of the session,
    latest_checkpoints of each layer the approved one of the highest version, then the last approved.
    """
    wanted = users.select("user_id").distinct()
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("session_id"))
    open_ = sessions.where(F.col("status").isin(*OPEN)).withColumn("_nth", F.row_number().over(newest)).where("_nth = 1")
    open_ = open_.select("user_id", "session_id", F.col("version").alias("_version"), F.col("status").alias("_status"), F.col("current_layer").alias("_layer"), F.col("completed_layers").alias("_done"))
    approved = checkpoints.where("status = 'approved'")
    last = Window.partitionBy("user_id", "layer").orderBy(F.desc("version"), F.desc_nulls_last("approved_at"), F.desc("session_id"))
    newest_of = _by_layer(approved.withColumn("_nth", F.row_number().over(last)).where("_nth = 1"), "user_id", "latest_checkpoints")
    own = _by_layer(approved.join(open_.select("session_id"), "session_id", "left_semi"), "session_id", "session_checkpoints")
    version = F.coalesce("current_version", F.lit(0)).cast("long")
    new = F.col("session_id").isNull()
    none = F.array().cast("array<string>")
    done = F.coalesce("_done", none)
    rows = wanted.join(profiles, "user_id", "left").join(open_, "user_id", "left").join(own, "session_id", "left").join(newest_of, "user_id", "left")
    return rows.select(
        "user_id", F.when(new, "draft").otherwise(F.coalesce("status", F.lit("draft"))).alias("profile_status"), version.alias("current_version"), "session_id", F.when(new, "in_progress").otherwise(F.col("_status")).alias("session_status"),
        F.when(new, F.greatest(version, F.lit(0)) + 1).otherwise(F.col("_version")).cast("long").alias("session_version"), done.alias("completed_layers"),
        F.when(new, LAYERS[0]).otherwise(F.coalesce("_layer", next_layer(done))).alias("pending_layer"), "session_checkpoints", "latest_checkpoints",
    )


#: The fields of an entry in a saved payload; details is any JSON.
ENTRY = "title string, summary string, cadence string, trigger string, inputs array<string>, stakeholders array<string>, constraints array<string>, details string, source_confidence string, status string"


def save_layers(sessions: DataFrame, entries: DataFrame, saves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, sessions and entries after saves (session_id, layer, payload, seq); of several for a layer the one with the highest seq counts.

    sessions (session_id, status, completed_layers), entries (session_id, layer, place, and the fields of ENTRY), payload a JSON array of entries,
    null as an empty one. The entries of a saved layer are replaced, in the payload's order from place 1; blank cadences
    and triggers are null. Completed layers stand in the layers' order; a session with all of them is ready for review.
    Results (session_id, layer, result): saved, invalid layer, payload is no JSON, entries are no array, session not found, or session is not editable.
    """
    rows = latest(saves, ["session_id", "layer"], [F.desc("seq")]).join(sessions.select("session_id", F.col("status").alias("_status"), F.lit(True).alias("_known")), "session_id", "left")
    broken = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
    wrong = F.col("payload").isNotNull() & ~F.trim("payload").startswith("[")
    result = (
        F.when(~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False)), "invalid layer").when(broken, "payload is no JSON").when(wrong, "entries are no array").when(F.col("_known").isNull(), "session not found")
        .when(~F.coalesce(F.col("_status").isin(*OPEN), F.lit(False)), "session is not editable").otherwise("saved")
    )
    judged = rows.select("session_id", "layer", "payload", result.alias("result"))
    saved = judged.where("result = 'saved'")
    items = F.from_json(F.coalesce("payload", F.lit("[]")), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ENTRY.split(', '))}>>")
    new = saved.select("session_id", "layer", F.posexplode(items).alias("_at", "e"))
    filled = lambda name: F.nullif(F.trim(F.col(f"e.{name}")), F.lit(""))
    listed = lambda name: F.coalesce(F.col(f"e.{name}"), F.array().cast("array<string>")).alias(name)
    new = new.select(
        "session_id", "layer", (F.col("_at") + 1).cast("long").alias("place"), F.trim("e.title").alias("title"), F.trim("e.summary").alias("summary"), filled("cadence").alias("cadence"), filled("trigger").alias("trigger"),
        listed("inputs"), listed("stakeholders"), listed("constraints"), F.coalesce("e.details", F.lit("{}")).alias("details"),
        F.coalesce(filled("source_confidence"), F.lit("confirmed")).alias("source_confidence"), F.coalesce(filled("status"), F.lit("active")).alias("status"),
    )
    kept = entries.join(saved.select("session_id", "layer"), ["session_id", "layer"], "left_anti")
    more = saved.groupBy("session_id").agg(F.collect_set("layer").alias("_more"))
    touched = F.col("_more").isNotNull()
    done = F.array_intersect(F.array(*map(F.lit, LAYERS)), F.concat(F.coalesce("completed_layers", F.array().cast("array<string>")), F.col("_more")))
    after = sessions.join(more, "session_id", "left").withColumn("completed_layers", F.when(touched, done).otherwise(F.col("completed_layers")))
    pending = next_layer(F.col("completed_layers"))
    layer = F.when(touched, pending).otherwise(F.col("current_layer")) if "current_layer" in sessions.columns else pending
    after = after.withColumn("current_layer", layer).withColumn("status", F.when(touched, F.when(pending == "review", "review_ready").otherwise("in_progress")).otherwise(F.col("status")))
    return judged.select("session_id", "layer", "result"), after.drop("_more"), kept.unionByName(new.select(*entries.columns))

"""Aggregations of a memory store. Counts come as rows (section, key, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.filters import not_restricted, since


def top_counts(rows: DataFrame, key: Column | str, section: str, limit: int | None = None) -> DataFrame:
    """(section, key, n) of the most frequent keys; a null key is a group of its own."""
    counts = rows.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count("*").alias("n"))
    counts = counts if limit is None else counts.orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(limit)
    return counts.select(F.lit(section).alias("section"), F.col("key").cast("string").alias("key"), "n")


def brain_stats(thoughts: DataFrame, as_of: str, days: int | None = None, exclude_restricted: bool = True, top: int = 20) -> DataFrame:
    """The total of all times, and the most frequent types and topics within some days."""
    rows = thoughts.where(not_restricted()) if exclude_restricted else thoughts
    recent = rows.where(since(F.col("created_at"), as_of, days))
    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(None).cast("string").alias("key"), "n")
    return total.unionByName(top_counts(recent, "type", "type", top)).unionByName(top_counts(recent.select(F.explode("topics").alias("topic")), "topic", "topic", top))


def stats_summary(thoughts: DataFrame, top: int = 10) -> DataFrame:
    """Total, first and last time, all types, and the most frequent topics and people; times are given as the key."""
    facts = thoughts.agg(F.count("*").alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    head = facts.select(F.explode(F.array(F.struct(F.lit("total").alias("section"), F.lit(None).cast("string").alias("key"), "n"), *[F.struct(F.lit(s).alias("section"), F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("key"), "n") for s, c in (("first", "a"), ("last", "b"))])).alias("r")).select("r.*")
    lists = [top_counts(thoughts.select(F.explode(c).alias(c)), c, c, top) for c in ("topics", "people")]
    return head.unionByName(top_counts(thoughts, "type", "type")).unionByName(lists[0]).unionByName(lists[1])


def share_done(rows: DataFrame, done: Column, per_hour: float) -> DataFrame:
    """done, open, percent done and hours that the rest takes at some rate."""
    facts = rows.agg(F.count_if(done).alias("done"), F.count_if(~F.coalesce(done, F.lit(False))).alias("open"))
    return facts.select("done", "open", F.round(100.0 * F.col("done") / F.nullif(F.col("done") + F.col("open"), F.lit(0)), 6).alias("percent"), F.round(F.col("open") / F.lit(float(per_hour)), 6).alias("hours"))


def threads(messages: DataFrame, thread: str, message: str, words: str, atom: str | None = None) -> DataFrame:
    """(thread, messages, atoms, words) of rows that may divide a message into atoms: its words count once."""
    each = messages.groupBy(thread, message).agg(F.count("*").alias("atoms"), F.max(words).alias("words"))
    return each.groupBy(thread).agg(F.count("*").alias("messages"), F.sum("atoms").alias("atoms"), F.sum("words").alias("words"))


def shopping_list(ingredients: DataFrame) -> DataFrame:
    """(name, unit, quantities, first_meal): quantities as text, joined in order of meal and place."""
    entry = F.struct("meal_id", "place", "quantity")
    rows = ingredients.groupBy("name", "unit").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.min("meal_id").alias("first_meal"))
    return rows.select("name", "unit", F.array_join("all.quantity", " + ").alias("quantities"), "first_meal")


def quiz_scores(answers: DataFrame) -> DataFrame:
    """(lesson_id, quizzes, average, best): a quiz's score is its rounded percentage of right answers."""
    each = answers.groupBy("lesson_id", "quiz_id").agg(F.round(100.0 * F.count_if("is_correct") / F.count("*")).alias("score"))
    return each.groupBy("lesson_id").agg(F.count("*").alias("quizzes"), F.round(F.avg("score"), 6).alias("average"), F.max("score").alias("best"))


def capped(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")

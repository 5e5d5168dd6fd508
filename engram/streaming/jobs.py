"""Structured Streaming: deduplication, queues, running thresholds, sessions and rate limits over streams of events."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def captures(stream: DataFrame, channel: str, delay: str = "10 minutes") -> DataFrame:
    """Messages (slack_ts, ts, channel, subtype, bot_id, text) of a channel by people, blank ones left out, each slack_ts once within the delay."""
    kept = stream.where((F.col("channel") == channel) & F.col("subtype").isNull() & F.col("bot_id").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["slack_ts"])


def event_sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "4 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap: (key, start, end, events)."""
    rows = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def rate_limited(stream: DataFrame, key: str, most: int = 30, time: str = "ts", width: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Sliding windows in which a key has more than most events."""
    rows = stream.withWatermark(time, delay).groupBy(key, F.window(time, width, slide).alias("w")).agg(F.count("*").alias("events"))
    return rows.where(F.col("events") > most).select(key, F.col("w.start").alias("start"), "events")


def habit_days(stream: DataFrame, key: str, time: str = "ts", delay: str = "1 day") -> DataFrame:
    rows = stream.withWatermark(time, delay).groupBy(key, F.window(time, "1 day").alias("w")).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("w.start").alias("day"), "events")


def _hour(rows: DataFrame, time: str) -> Column:
    """A number or string that never falls as the time rises, the same within an hour: a string's hour is its first 13 characters."""
    kind = rows.schema[time].dataType.simpleString()
    if kind == "string":
        return F.substring(time, 1, 13)
    if kind == "date":
        return F.unix_date(time)
    return F.unix_date(F.col(time).cast("date")) * 24 + F.hour(time) if kind.startswith("timestamp") else F.floor(F.col(time) / 3600).cast("long")


def thresholds(stream: DataFrame, key: str, accepted: str, time: str = "ts", tie: str = "event_id", start: float = 0.75, step: float = 0.02, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """The threshold of each key after each batch: down a step for an acceptance, up for a rejection, within bounds, kept as state.

    A run of steps is the map x -> min(max(x + shift, from_low), from_high). The steps of each hour of a key are composed in a task of
    their own first, so that the state's task meets one row for each hour of a batch.
    """
    moved = lambda value, oks: reduce(lambda v, ok: min(high, max(low, v - step if ok else v + step)), oks, value)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        out = []
        for (name, hour), some in pd.concat(rows).groupby(["_key", "_hour"], dropna=False, sort=False):
            oks = list(some.sort_values(["_time", "_tie"])["_ok"])
            out.append((name, hour, step * sum(-1 if ok else 1 for ok in oks), moved(-math.inf, oks), moved(math.inf, oks), len(oks)))
        yield pd.DataFrame(out, columns=["_key", "_hour", "shift", "from_low", "from_high", "n"])

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen = state.get if state.exists else (start, 0)
        hours = pd.concat(list(batches)).sort_values("_hour")
        for r in hours.itertuples(index=False):
            value = min(max(value + r.shift, r.from_low), r.from_high)
        seen += int(hours["n"].sum())
        state.update((value, seen))
        yield pd.DataFrame({key: [keys[0]], "threshold": [round(value, 6)], "outcomes": [seen]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("_key"), _hour(stream, time).alias("_hour"), F.col(time).alias("_time"), F.col(tie).alias("_tie"), F.col(accepted).alias("_ok"))
    hours = rows.repartition("_key", "_hour").mapInPandas(compose, f"_key {kind}, _hour {rows.schema['_hour'].dataType.simpleString()}, shift double, from_low double, from_high double, n long")
    return hours.withColumnRenamed("_key", key).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, threshold double, outcomes long", "value double, seen long", "update", GroupStateTimeout.NoTimeout)


def once_by_key(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends what the folder doesn't have yet. A batch that is run again writes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def enqueue_changes(thoughts_path: str, queue_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the batch's thoughts (id, content) become the known ones, and those that changed are queued.

    Each batch's results go to a folder of its number, which it overwrites, so that a batch that is run again leaves the same.
    """
    from engram.functions.text import fingerprint
    from engram.operators.upsert import changed, latest

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch, ["id"], [F.desc("content")]).select("id", fingerprint(F.col("content")).alias("fp"), F.lit(number).cast("bigint").alias("batch"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(thoughts_path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.schema("id bigint, fp string, batch bigint").option("recursiveFileLookup", "true").parquet(thoughts_path).where(F.col("batch") < number)
            todo = changed(latest(known, ["id"], [F.desc("batch")]).select("id", "fp"), rows, "id", "fp")
        else:
            todo = rows
        todo.select("id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "batch").write.mode("overwrite").parquet(f"{queue_path}/{number}")
        rows.write.mode("overwrite").parquet(f"{thoughts_path}/{number}")

    return write


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, name: str | None = None, mode: str = "append") -> None:
    """All that is there now, then stop: into a sink or into a table in memory. This is what a scheduled job calls."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    query = writer.foreachBatch(sink).start() if sink else writer.format("memory").queryName(name).start()
    query.awaitTermination()


class _Limit(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, and are then judged in order; what is kept of those let through is their times."""

    def __init__(self, most: int, width: int, kind: str):
        self.most, self.width, self.kind = most, width, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, tie {self.kind}")
        self.taken = handle.getListState("taken", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            ats = [int(x) for x in some["at"]]
            self.waiting.appendList(list(zip(ats, some["tie"], strict=True)))
            first = min(ats) if first is None else min(first, *ats)
        self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame(columns=["name", "at", "tie", "ok"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        due, rest = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        taken, oks = deque(x[0] for x in self.taken.get()), []
        for at, _ in due:
            while taken and taken[0] < at - self.width:
                taken.popleft()
            oks.append(len(taken) < self.most)
            if oks[-1]:
                taken.append(at)
        # a time that no later row can meet any more is not kept; a key without any is forgotten
        while taken and taken[0] < now - self.width:
            taken.popleft()
        for state, left in ((self.waiting, rest), (self.taken, [(x,) for x in taken])):
            if left:
                state.put(left)
            else:
                state.clear()
        if rest or taken:
            self.handle.registerTimer(-(-min([x[0] for x in rest[:1]] or [taken[0] + self.width + 1000]) // 1000))
        if due:
            yield pd.DataFrame({"name": pd.Series([key[0]] * len(due), dtype=object), "at": [x[0] for x in due], "tie": [x[1] for x in due], "ok": oks})

    def close(self) -> None:
        pass


def limited(stream: DataFrame, key: str, time: str = "ts", tie: str = "event_id", most: int = 30, seconds: float = 60, delay: str = "1 minute") -> DataFrame:
    """(key, time, tie, ok) of a stream as `windows.rate_limit` gives it for its rows at once: fewer than most let through in the seconds before; those turned away don't count.

    A row is judged when the watermark has passed it, so files may come in any order within the delay; rows later than that, and
    rows without a time, go. State is the rows that wait and at most so many times for each key, and nothing once they are older than the seconds.
    A key's rows are judged in one task, since each decision rests on the one before. Sets the session's state store to RocksDB, which timers need.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    key_kind, kind = stream.schema[key].dataType.simpleString(), stream.schema[tie].dataType.simpleString()
    # Python gets rows whose names can't begin with an underscore
    rows = stream.where(F.col(time).isNotNull()).select(F.col(key).alias("name"), F.col(time).cast("timestamp").alias("moment"), F.col(tie).alias("tie")).withWatermark("moment", delay).withColumn("at", F.unix_micros("moment"))
    judged = rows.groupBy("name").transformWithStateInPandas(_Limit(most, round(seconds * 1_000_000), kind), f"name {key_kind}, at long, tie {kind}, ok boolean", "append", "eventTime")
    return judged.select(F.col("name").alias(key), F.timestamp_micros("at").alias(time), F.col("tie").alias(tie), "ok")

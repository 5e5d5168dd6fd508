"""Sessions, batches, running state and digests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, key: str, time: str, tie: str, hours: int = 4) -> DataFrame:
    """Adds session, counted from 0 for each key: a new one starts after a gap of so many hours. Rows without a time stay in the current one."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.col(time) - F.lag(time).over(w) >= F.expr(f"make_dt_interval(0, {hours})")
    return rows.withColumn("session", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Adds batch: the rows of a key in order, so many at a time."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("bigint"))


def in_slices(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds _slice: partitions by range of keys and order, numbered in that order. A key with many rows is in many of them."""
    return rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())


def adaptive_threshold(rows: DataFrame, key: str, order: Sequence[str], accepted: str, start: float = 0.75, step: float = 0.02, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """(key, threshold, outcomes): a threshold that falls by a step with each acceptance and rises with each rejection, within bounds.

    A run of steps within bounds is the map x -> min(max(x + shift, lo), hi), and such maps compose to one of that kind.
    They are composed over batches within ranges of a key's rows first, then over each range's batches and then over the ranges in order,
    so no key's rows are gathered or numbered in one task.
    """
    size = 1000
    cut = batches(in_slices(rows, [key], order), [key, "_slice"], order, size)
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.when(F.col(accepted), -1).otherwise(1).alias("by")))), lambda x: x["by"])
    # counted in half steps, so that sums are exact
    grid = F.lit(2)
    lo, hi, begin = (F.lit(round(2 * x / step)) for x in (low, high, start))
    shift = lambda s: F.aggregate(s, F.lit(0), lambda a, b: a + b * grid)
    at = lambda s, x: F.aggregate(s, x, lambda a, b: F.greatest(F.least(a + b * grid, hi), lo))
    parts = cut.groupBy(key, "_slice", "batch").agg(steps.alias("s")).select(key, "_slice", "batch", F.size("s").cast("bigint").alias("n"), shift(F.col("s")).cast("bigint").alias("shift"), at(F.col("s"), lo).alias("from_low"), at(F.col("s"), hi).alias("from_high"))
    gathered = lambda df, keys, place: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place, "shift", "from_low", "from_high"))).alias("p"), F.sum("n").cast("bigint").alias("n"))
    run = lambda x: F.aggregate("p", x.cast("bigint"), lambda a, p: F.greatest(F.least(a + p["shift"], p["from_high"].cast("bigint")), p["from_low"].cast("bigint")))
    sliced = gathered(parts, [key, "_slice"], "batch").select(key, "_slice", "n", F.aggregate("p.shift", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("shift"), run(lo).alias("from_low"), run(hi).alias("from_high"))
    folded = gathered(sliced, [key], "_slice").withColumnRenamed("n", "outcomes")
    value = run(begin)
    return folded.select(key, F.round(value * step / 2, 6).alias("threshold"), "outcomes")


def digest(thoughts: DataFrame, least: int, enough: int, otherwise: int, most: int) -> DataFrame:
    """The thoughts of some importance or more by importance and time; if they are too few, the first of all thoughts."""
    order = [F.desc("importance"), F.desc("created_at"), F.col("id")]
    few = thoughts.agg((F.count_if(F.col("importance") >= least) < enough).alias("few"))
    rows = thoughts.crossJoin(F.broadcast(few)).where(F.col("few") | (F.col("importance") >= least)).orderBy(*order).limit(max(most, otherwise))
    n = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= F.when(F.col("few"), otherwise).otherwise(most)).drop("_n", "few")


def rate_limit(rows: DataFrame, key: str, time: str, tie: str, most: int = 30, seconds: float = 60) -> DataFrame:
    """(key, time, tie, ok): whether a row is let through, which it is if fewer than most were in the seconds before it. Those turned away don't count.

    A key's rows pass in order of time; what is kept of them is the times of the last ones let through, so a key of any size streams through
    its task. Rows without a time go.
    """
    kind = {c: rows.schema[c].dataType.simpleString() for c in (key, tie)}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = None, deque()
        for batch in batches:
            oks = []
            for k, none, at in zip(batch["_k"], batch["_none"], batch["_at"], strict=True):
                if now != (none, None if none else k):
                    now, taken = (none, None if none else k), deque()
                while taken and taken[0] < at - width:
                    taken.popleft()
                oks.append(len(taken) < most)
                if oks[-1]:
                    taken.append(at)
            yield batch.drop(columns=["_none"]).assign(ok=oks)

    width = round(seconds * 1_000_000)
    inner = rows.where(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(key).isNull().alias("_none"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), F.col(tie).alias("_tie"))
    judged = inner.repartition("_k").sortWithinPartitions("_k", "_at", "_tie").mapInPandas(judge, f"_k {kind[key]}, _at long, _tie {kind[tie]}, ok boolean")
    return judged.select(F.col("_k").alias(key), F.timestamp_micros("_at").alias(time), F.col("_tie").alias(tie), "ok")

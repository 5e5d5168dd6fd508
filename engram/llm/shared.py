"""The shared folder, and connected components: what several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, the folder that the driver and all executors see.

    Where the setting is absent a session of one machine gets a temporary folder; on a cluster that would be another
    folder on each, so RuntimeError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="engram-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back, which also cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._engram_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialised tables that nothing reads any more: what was made of them is itself written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._engram_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key with so many rows, or with 2^-16 of all rows if that is more, is dealt out: there are 2^16 such keys at most.
HOT = 256
SALTS = 32


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], by: str, how: str = "left") -> DataFrame:
    """rows, which are materialised, joined with other by keys. The rows of a hot key are dealt out to SALTS tasks by a hash of by.

    The list of hot keys is bounded by HOT's rule and broadcast, so both sides know them without a shuffle.
    """
    least = max(HOT, rows.count() >> 16)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, component), component the smallest node.

    Contraction: every node moves to the neighbour (or itself) with the smallest hashed id, edges follow their ends and
    those within one node go. A hashed order makes long paths shrink by a constant factor a round. Only nodes that occur
    in edges are returned. An empty table gives an empty one; null ends and loops are left out. All nodes of a large component
    come to have one place; the joins by it end in a file, with no exchange after them, so that Spark splits such a place as it runs.
    """
    spark = edges.sparkSession
    live = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    placed = materialise(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("at")), name)
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        step = materialise(ends.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("at"), F.least(key("a"), F.col("m"))["id"].alias("to")), name)
        moved = materialise(placed.join(step, "at", "left").select("node", F.coalesce("to", "at").alias("at")), name)
        left, right = step.toDF("a", "ta"), step.toDF("b", "tb")
        rest = materialise(live.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), name)
        discard(step, placed, live)
        placed, live = moved, rest
    smallest = placed.groupBy("at").agg(F.min("node").alias("component"))
    out = materialise(placed.join(smallest, "at").select("node", "component"), name)
    discard(placed, live)
    return out

"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. A session of one machine without the setting gets a temporary folder; on a cluster RuntimeError is raised."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="engram-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Within, what a query shuffles is deleted when it ends and not when its DataFrame is collected, so that steps don't add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """df written once to a folder that all machines share, and read back. Its shuffles are deleted then."""
    return cut_each([df])


def cut_each(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts, which are written one after the other to one folder and read back as one. What a part shuffles is deleted before the next begins."""
    path = None
    for df in parts:
        path = path or folder(df.sparkSession, "cut")
        with _freed(df.sparkSession):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Sinks: backups as JSON lines and digests as Markdown lines, as rows that any writer stores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.filters import since


def backup(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, line): each row of each table as a JSON object. df.write.partitionBy("table").text(path) stores them."""
    parts = [df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("line")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def restore(lines: DataFrame, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of a backup, by their schemas."""
    return {name: lines.where(F.col("table") == name).select(F.from_json("line", schema).alias("r")).select("r.*") for name, schema in schemas.items()}


def digest_lines(thoughts: DataFrame, as_of: str, days: int, size: int = 120) -> DataFrame:
    """(section, place, line): Markdown bullets of the recent thoughts by type, the most important first."""
    from pyspark.sql import Window

    rows = thoughts.where(since(F.col("created_at"), as_of, days) & F.col("type").isNotNull())
    n = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("importance"), "id"))
    line = F.concat(F.lit("- "), F.regexp_replace(F.substring("content", 1, size), r"\s+", " "), F.lit(" (#"), "id", F.lit(")"))
    return rows.select(F.col("type").alias("section"), n.cast("bigint").alias("place"), line.alias("line"))

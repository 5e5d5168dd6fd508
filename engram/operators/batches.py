"""How many rows a Python step has at a time, so that its memory doesn't grow with the rows of a task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def small(df: DataFrame, size: str = "4m") -> DataFrame:
    """df for a Python step: the session hands over batches of that many bytes at most, or of one row. Spark's default is 64 MB for each worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def few(batches: Iterator[pd.DataFrame], rows: int = 100) -> Iterator[pd.DataFrame]:
    """The rows of batches, so many at a time, for steps that give more than they get."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]

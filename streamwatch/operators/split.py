"""Main / side output split (K2): the high / low temperature ProcessFunction of job 2.2.

A side output is just a second filter over the same input; Catalyst pushes
each predicate into the scan. ``tag_split`` keeps both in one DataFrame with a
``kind`` column, which is what a single sink (or ``foreachBatch``) writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where pred is true, rows where it is false or null)."""
    return df.where(pred), df.where(~F.coalesce(pred, F.lit(False)))


def tag_split(df: DataFrame, pred: Column, main: str = "high", side: str = "low",
              kind: str = "kind") -> DataFrame:
    return df.withColumn(kind, F.when(F.coalesce(pred, F.lit(False)), F.lit(main))
                         .otherwise(F.lit(side)))


def threshold_split(df: DataFrame, value: str, threshold: float, **kw) -> DataFrame:
    """High when value > threshold; a value equal to the threshold is low."""
    return tag_split(df, F.col(value) > F.lit(threshold), **kw)

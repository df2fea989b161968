"""Stream <-> table and SQL (P5): a DataFrame, batch or streaming, becomes a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)

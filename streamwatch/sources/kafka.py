"""Kafka in and out (S2, S3; job 1).

What a value holds is decoded and encoded by ``decode_values`` and
``encode_values``, which take any DataFrame with a ``value`` column and are tested
on file streams. The transport (``read_kafka``, ``write_kafka``) is Spark's
connector and untested: its jar is not on this machine's classpath. On a cluster,
add ``org.apache.spark:spark-sql-kafka-0-10`` to ``spark.jars.packages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logs import BAD_LINE, _parsed, parse_lines


def decode_values(df: DataFrame, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """``value`` (text or bytes, one CSV or JSON record) -> the schema's columns and ``bad_line``.

    A value that is no record keeps its text in ``bad_line``, with the columns that
    could be read or null; good records have null there. No row is dropped.
    """
    if fmt == "csv":
        return parse_lines(df, schema, keep_bad=True)
    if fmt != "json":
        raise ValueError("fmt must be csv or json")
    return _parsed(df, F.col("value").cast("string"), schema, "json", True)


def encode_values(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows -> ``key`` (text, if a column is named) and ``value`` (a JSON object with every column, nulls included)."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value.alias("value"))


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType | None = None,
               fmt: str = "csv", starting_offsets: str = "latest", options: dict | None = None) -> DataFrame:
    """A topic's values; with a schema decoded, with ``bad_line`` beside its columns."""
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic)
         .option("startingOffsets", starting_offsets))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    raw = r.load()
    if schema is None:
        return raw.select(F.col("value").cast("string").alias("value"), "timestamp")
    return decode_values(raw, schema, fmt)


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str,
                key: str | None = None, output_mode: str = "append"):
    return (encode_values(df, key).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
            .option("checkpointLocation", checkpoint)
            .outputMode(output_mode)
            .start())


def kafka_pipe(spark: SparkSession, servers: str, in_topic: str, out_topic: str, checkpoint: str,
               schema: T.StructType | None = None, transform=None, fmt: str = "csv"):
    """Job 1: Kafka in -> (optional DataFrame transform) -> Kafka out, as JSON values.

    Values that are no record do not go on; read the topic with ``read_kafka`` to have them."""
    df = read_kafka(spark, servers, in_topic, schema, fmt)
    if schema is not None:
        df = df.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    if transform is not None:
        df = transform(df)
    return write_kafka(df, servers, out_topic, checkpoint)

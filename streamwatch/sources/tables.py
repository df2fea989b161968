"""Test-table inputs (``/root/testdata/sf*/``) and how the jobs bind to them.

``events(event_id, ts timestamp_ntz, user_id, event_type, value, props)`` is
the stream; ``customer`` and ``nation`` supply channel and region. Reads are
plain parquet scans, so Catalyst pushes each job's filter and column list into
the scan (``PushedFilters`` / ``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sf_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def prop_k(props: str = "props") -> Column:
    """The integer ``k`` of the ``props`` JSON, used as item / page address."""
    return F.get_json_object(F.col(props), "$.k").cast("long")


def user_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id -> channel (customer market segment)."""
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("channel"))


def user_province(spark: SparkSession, sf_dir: str, region: bool = False) -> DataFrame:
    """user_id -> province (nation name of the customer), with ``region`` also the name of its region.

    All tables are left to the planner: the size-checked broadcast threshold,
    and AQE at run time.
    """
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nationkey"))
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("province"), F.col("n_regionkey").alias("regionkey"))
    if not region:
        return cust.join(nation.drop("regionkey"), "nationkey").select("user_id", "province")
    names = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("region"))
    return cust.join(nation, "nationkey").join(names, "regionkey").select("user_id", "province", "region")

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on ``names`` that ``df`` does not use (Spark names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def literal_array(values: list, kind: str) -> Column:
    """A constant array from a bounded driver-side list, folded to one literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is not None:
            return
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared, durable folder")
        d = tempfile.mkdtemp(prefix="llm-ckpt-")
    spark.sparkContext.setCheckpointDir(d)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Give memory that a Python task has freed back to the system: workers live on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the GNU library only
    if trim is not None:
        trim(0)


def one_row_per_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row for each value of ``key`` (null is a value): its smallest text.

    Unique keys, the usual case, are only counted, not shuffled with their texts.
    """
    repeated = df.groupBy(key).count().where("count > 1")
    if repeated.isEmpty():
        return df
    return df.groupBy(key).agg(F.min(text).alias(text))


def bucket_of(col: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) at or below ``col``, by a two-level search."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    arr = literal_array(bounds, "bigint")
    tops = literal_array(bounds[::step], "bigint")
    block = F.size(F.filter(tops, lambda b: b <= col))
    start = F.greatest(block - 1, F.lit(0)) * step
    inner = F.size(F.filter(F.slice(arr, start + 1, F.lit(step)), lambda b: b <= col))
    return start + inner

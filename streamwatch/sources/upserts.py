"""Results that are corrected (S6 with allowed lateness): update mode, a version of each row per epoch.

An append-mode window waits until the watermark has passed; results come late and
once. In update mode every micro-batch gives the windows it has changed at once,
and late rows within the watermark's delay (the allowed lateness) correct windows
that are out already. ``write_upserts`` keeps the changed rows of an epoch in a
folder of its own, which a batch that failed half way and runs again overwrites;
``read_latest`` gives the newest version of each key, so one row a window however
often it was corrected or written. ``compact`` merges the epochs that it names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_location

EPOCH = "epoch"


def write_upserts(df: DataFrame, path: str, name: str = "upserts", fmt: str = "parquet", trigger: dict | None = None,
                  checkpoint: str | None = None):
    """Start a streaming query in update mode whose changed rows go to ``path/epoch=N``. Returns the StreamingQuery.

    Epoch numbers go on from the checkpoint, so ``path`` belongs to one checkpoint:
    by default that of the name and the path.
    """
    if EPOCH in df.columns:
        raise ValueError(f"the column {EPOCH} is taken")

    def each(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{EPOCH}={epoch_id}")

    own = f"{name}_{hashlib.md5(path.encode()).hexdigest()[:12]}"
    w = (df.writeStream.outputMode("update").foreachBatch(each)
         .option("checkpointLocation", checkpoint or checkpoint_location(df.sparkSession, own)))
    return (w.trigger(**trigger) if trigger else w).start()


def _versions(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).option("basePath", path).load(path).withColumn(EPOCH, F.col(EPOCH).cast("long"))


def read_latest(spark: SparkSession, path: str, keys: list[str], fmt: str = "parquet", versions: bool = False) -> DataFrame:
    """The newest row of each key (null is a value), in one shuffle with map-side combining.

    ``versions`` adds ``first_epoch``, ``epoch`` (of the row) and ``n_versions``.
    """
    rows = _versions(spark, path, fmt)
    values = [c for c in rows.columns if c not in (*keys, EPOCH)]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in values]) if values else F.lit(True), F.col(EPOCH)).alias("_last")
    found = rows.groupBy(*keys).agg(last, F.min(EPOCH).alias("first_epoch"), F.max(EPOCH).alias(EPOCH), F.count(F.lit(1)).alias("n_versions"))
    return found.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in values], *(["first_epoch", EPOCH, "n_versions"] if versions else []))


def compact(spark: SparkSession, path: str, keys: list[str], target: str, upto: int, fmt: str = "parquet") -> None:
    """Write the newest versions up to epoch ``upto`` to ``target/epoch=upto``.

    Readers of ``target`` plus later epochs of ``path`` see what they saw before; the
    old folder is left to its owner. Give an epoch that the query has completed.
    """
    rows = _versions(spark, path, fmt).where(F.col(EPOCH) <= upto)
    values = [c for c in rows.columns if c not in (*keys, EPOCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in values]) if values else F.lit(True), F.col(EPOCH)).alias("_last"))
    newest.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in values]).write.mode("overwrite").format(fmt).save(f"{target.rstrip('/')}/{EPOCH}={upto}")

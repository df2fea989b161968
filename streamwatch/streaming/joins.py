"""Stream-stream interval join (J2, job 3.9 intervalJoin) and the split sink (K2).

J2 is Spark's symmetric hash join: both sides carry a watermark, and the time
range in the join condition lets Spark drop each side's buffered rows once
the other side's watermark proves they can no longer match.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_us, with_delay
from ..session import checkpoint_location


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, lower, upper,
                         left_delay="0 seconds", right_delay="0 seconds",
                         right_key: str | None = None) -> DataFrame:
    """Inner join with ``lower <= right.rts - left.lts <= upper`` (inclusive); key dropped from the right.
    A delay of None: that side carries a watermark."""
    rk = right_key or key
    lo, hi = duration_us(lower), duration_us(upper)
    L = with_delay(left, lts, left_delay)
    R = with_delay(right, rts, right_delay).withColumnRenamed(rk, "_rk")
    cond = ((L[key] == R["_rk"])
            & (R[rts] >= L[lts] + F.expr(f"INTERVAL {lo} MICROSECONDS"))
            & (R[rts] <= L[lts] + F.expr(f"INTERVAL {hi} MICROSECONDS")))
    return L.join(R, cond, "inner").drop("_rk")


def write_split(df: DataFrame, pred: Column, main_path: str, side_path: str, name: str = "split",
                fmt: str = "parquet", trigger: dict | None = None):
    """Main / side output of one stream (job 2.2): each micro-batch is written twice,
    filtered, inside ``foreachBatch``. Returns the StreamingQuery.

    Each micro-batch overwrites its own ``epoch=N`` folder in both outputs, so a batch
    that failed between the two and runs again leaves no row twice.
    """
    hit = F.coalesce(pred, F.lit(False))

    def each(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()
        batch.where(hit).write.mode("overwrite").format(fmt).save(f"{main_path}/epoch={epoch_id}")
        batch.where(~hit).write.mode("overwrite").format(fmt).save(f"{side_path}/epoch={epoch_id}")
        batch.unpersist()

    w = (df.writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint_location(
             df.sparkSession, f"{name}_{hashlib.md5(f'{main_path} {side_path}'.encode()).hexdigest()[:12]}")))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()

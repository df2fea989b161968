"""As-of join (J3): for each left row the latest right row of its key at or before it.

A tagged union of both sides is shuffled once by (key, time bucket); inside a
bucket a running last value answers, and a left row with no right row before it in
its bucket takes the last one of the key's earlier buckets, carried over one
summary row a bucket. No row is copied and a hot key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import duration_us, to_us
from .patterns import _as_list, _by_bucket, _join_back


def asof_join(left: DataFrame, right: DataFrame, key, left_ts: str, right_ts: str, tolerance=None, tiebreak: str | None = None,
              bucket=None) -> DataFrame:
    """``left`` plus the right columns (but the key; null where there is no row).

    At equal times the right row counts. Of right rows at the same time the one with
    the largest ``tiebreak`` (a right column) is the latest. ``tolerance``: how old the
    right row may be, inclusive. Rows without a key or time have no partner; every
    left row appears once.
    """
    keys = _as_list(key)
    values = [c for c in right.columns if c not in keys]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns if c not in keys])
    found = F.struct(*[F.col(f"`{c}`") for c in values])
    usable = F.col(right_ts).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    no_right, no_left = F.lit(None).cast(right.select(found).schema[0].dataType), F.lit(None).cast(left.select(row).schema[0].dataType)
    tie = F.col(tiebreak) if tiebreak else F.lit(0)
    ltie = F.lit(None).cast(right.select(tie.alias("t")).schema[0].dataType)
    # at equal times: right rows by their tiebreak, then left rows
    both = (right.where(usable).select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), no_left.alias("_l"), found.alias("_r"))
            .unionByName(left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), ltie.alias("_tie"), row.alias("_l"), no_right.alias("_r"))))
    rows = _by_bucket(both, keys, "_t", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in", F.last("_r", ignorenulls=True).over(inside))
    last = F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_last")
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # the summary counts left rows too, so both branches need the same columns and share one shuffle and one read
    carry = rows.groupBy(*keys, "_b").agg(last, F.count("_l").alias("_n")).where("_n >= 0")
    carry = carry.withColumn("_before", F.last("_last", ignorenulls=True).over(along))
    j = _join_back(rows.where("_side = 1"), carry, keys, ["_before"]).withColumn("_m", F.coalesce("_in", "_before"))
    good = F.col("_t").isNotNull()
    if tolerance is not None:
        good = good & (to_us("_t") - to_us(F.col(f"_m.`{right_ts}`")) <= F.lit(duration_us(tolerance)))
    return j.select(*[F.col(c) if c in keys else F.col(f"_l.`{c}`").alias(c) for c in left.columns],
                    *[F.when(good, F.col(f"_m.`{c}`")).alias(c) for c in values])

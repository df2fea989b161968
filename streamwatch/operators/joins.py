"""Two-stream joins: interval join (J2, job 3.9 intervalJoin) and reconciliation (J1, job 3.9 connect).

A row ``l`` of the left side matches ``r`` of the right side when the keys are
equal (a null key never matches) and ``lower <= r.ts - l.ts <= upper``, both
bounds inclusive.

A plain equi-join on the key with the range as a residual filter compares
every pair of a key, which for a hot key is quadratic. Here time is cut into
buckets of width ``W`` (at least the range width): each right row is copied
to every bucket that can hold a left row it matches (at most
``1 + ceil((upper - lower) / W)`` buckets), each left row sits in exactly one
bucket, and the join is an equi-join on (key, bucket) plus the range test.
Each matching pair meets in exactly one bucket, so inner, semi, anti and
left-outer joins are all exact, and only pairs in neighbouring buckets are
ever compared.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import home_bucket, range_buckets
from ..functions.time import duration_us, to_us

MIN_BUCKET_US = 1_000_000


def interval_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, lower, upper,
                  how: str = "inner", bucket=None, right_key: str | None = None) -> DataFrame:
    """Join on key with ``lower <= right.rts - left.lts <= upper``.

    Column names other than the key must not collide between the sides.
    ``how``: inner, left (outer), left_semi, left_anti. The result keeps the
    left columns and, for inner / left, the right ones (right key dropped).
    """
    lo, hi = duration_us(lower), duration_us(upper)
    if hi < lo:
        raise ValueError("upper must be >= lower")
    width = duration_us(bucket) if bucket is not None else max(hi - lo, MIN_BUCKET_US)
    rk = right_key or key
    L = left.withColumn("_lb", home_bucket(lts, width)).withColumn("_lus", to_us(lts))
    # right row r matches left times in [r - hi, r - lo]
    R = (right.withColumnRenamed(rk, "_rk")
              .withColumn("_rb", F.explode(range_buckets(rts, -hi, -lo, width)))
              .withColumn("_rus", to_us(rts)))
    cond = ((L[key] == R["_rk"]) & (L["_lb"] == R["_rb"])
            & (R["_rus"] - L["_lus"] >= F.lit(lo)) & (R["_rus"] - L["_lus"] <= F.lit(hi)))
    out = L.join(R, cond, how)
    drop = ["_lb", "_lus"] + ([] if how in ("left_semi", "left_anti") else ["_rk", "_rb", "_rus"])
    return out.drop(*drop)


def reconcile(pays: DataFrame, receipts: DataFrame, key: str, pay_ts: str, receipt_ts: str,
              lower, upper, bucket=None, bucket_factor: int = 8) -> DataFrame:
    """Tagged union of ``matched`` pairs, ``pay_only`` and ``receipt_only`` rows.

    Every column of both inputs is kept (the names must differ apart from
    the key); columns of the absent side are null. ``kind`` says which.

    Plan. Pairs: the bucketed interval join (only pay x receipt pairs of
    neighbouring buckets are compared). Lonely rows: one pass over the union
    of both sides, shuffled by (key, time bucket) with rows near a bucket edge
    copied into the neighbour, using only *unbounded-preceding* frames, which
    Spark evaluates incrementally (O(1) per row, however dense the key):
    a receipt has a pay iff the latest pay at or before ``receipt - lower`` is
    at or after ``receipt - upper``; a pay has a receipt iff the earliest
    receipt at or after ``pay + lower`` (a running ``last`` over negated time)
    is at or before ``pay + upper``. No bounded sliding frame is used: Spark
    re-aggregates those per row, which is quadratic on a dense key.
    """
    lo, hi = duration_us(lower), duration_us(upper)
    if hi < lo:
        raise ValueError("upper must be >= lower")
    horizon = max(abs(lo), abs(hi), 1)
    width = duration_us(bucket) if bucket is not None else max(horizon * bucket_factor, MIN_BUCKET_US)
    if width < horizon:
        raise ValueError("bucket width must be at least max(|lower|, |upper|)")
    pcols = [c for c in pays.columns if c != key]
    rcols = [c for c in receipts.columns if c != key]

    matched = (interval_join(pays, receipts, key, pay_ts, receipt_ts, timedelta(microseconds=lo),
                             timedelta(microseconds=hi), bucket=bucket)
               .select(key, F.lit("matched").alias("kind"), *pcols, *rcols))

    p = pays.select(F.col(key).alias("_key"), to_us(pay_ts).alias("_us"), F.struct(*pcols).alias("_p"))
    r = receipts.select(F.col(key).alias("_key"), to_us(receipt_ts).alias("_us"),
                        F.struct(*rcols).alias("_r"))
    ptype, rtype = p.schema["_p"].dataType, r.schema["_r"].dataType
    rows = (p.select("_key", "_us", "_p", F.lit(None).cast(rtype).alias("_r"))
             .unionByName(r.select("_key", "_us", F.lit(None).cast(ptype).alias("_p"), "_r")))
    home = F.floor(F.col("_us") / F.lit(width)).cast("long")
    off = F.col("_us") - home * F.lit(width)
    buckets = F.array_compact(F.array(
        home, F.when(off < F.lit(horizon), home - 1), F.when(F.lit(width) - off <= F.lit(horizon), home + 1)))
    # A null key never matches; a hash salt spreads such rows instead of gathering them.
    nokey = F.col("_key").isNull()
    rows = (rows.withColumn("_home_b", home).withColumn("_b", F.explode(buckets))
                .withColumn("_home", F.col("_b") == F.col("_home_b"))
                .withColumn("_ns", F.when(nokey, F.xxhash64("_us", "_p", "_r")).otherwise(F.lit(0)))
                .withColumn("_neg", -F.col("_us")))
    part = ["_key", "_b", "_ns"]
    up = Window.partitionBy(*part).orderBy("_us").rangeBetween(Window.unboundedPreceding, -lo)
    down = Window.partitionBy(*part).orderBy("_neg").rangeBetween(Window.unboundedPreceding, -lo)
    rows = (rows.withColumn("_last_pay", F.last(F.when(F.col("_p").isNotNull(), F.col("_us")),
                                                ignorenulls=True).over(up))
                .withColumn("_next_rec", F.last(F.when(F.col("_r").isNotNull(), F.col("_us")),
                                                ignorenulls=True).over(down)))
    has_rec = ~nokey & F.coalesce(F.col("_next_rec") <= F.col("_us") + F.lit(hi), F.lit(False))
    has_pay = ~nokey & F.coalesce(F.col("_last_pay") >= F.col("_us") - F.lit(hi), F.lit(False))
    # both kinds of lonely rows from one projection, so both windows run once
    lonely = rows.where(F.col("_home") & ((F.col("_p").isNotNull() & ~has_rec)
                                          | (F.col("_r").isNotNull() & ~has_pay))).select(
        F.col("_key").alias(key),
        F.when(F.col("_p").isNotNull(), F.lit("pay_only")).otherwise(F.lit("receipt_only")).alias("kind"),
        *[F.col(f"_p.{c}").alias(c) for c in pcols], *[F.col(f"_r.{c}").alias(c) for c in rcols])
    return matched.unionByName(lonely)

"""Continuous-rise alarm (K1): job 2.1, a sensor rising for ``duration`` raises one alarm.

Rules (SURVEY 2.9(4)): a sample rises when its value is strictly greater than
the key's previous sample (in event time, then tiebreak order); a fall, an
equal value or a null breaks the run. The clock starts at the first rising
sample of a run. A run alarms once, at ``run_start + duration``, when it still
rises at or after that instant, i.e. its last rising sample is at least
``duration`` after its first.

The previous sample of a key can be arbitrarily far back and a run can be
arbitrarily long, so this is a prefix scan over each key's sequence. Sorting
a key's whole sequence in one task (``method='single'``) pins a hot sensor
to one task; the default ``method='buckets'`` scans in two levels:

1. rows are ordered within (key, time bucket) only; each bucket is reduced to
   a few facts (first / last value, whether it has a break after its first
   row, the start of the run still open at its end);
2. a window over each key's *bucket summaries* (one row per non-empty
   bucket, bounded by time span / bucket width) carries the last value and
   the open run's start from bucket to bucket;
3. the carry is joined back, and every rising row gets its run start; runs
   are then a hash aggregate on (key, run start).

No group in any step is larger than one bucket of one key or the number of
buckets of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import duration_us, from_us, to_us

DEFAULT_BUCKET = "1 hour"


def _alarms(rises: DataFrame, keys, dur: int, like) -> DataFrame:
    runs = rises.groupBy(*keys, "_start").agg(F.max("_us").alias("_last"))
    return (runs.where(F.col("_last") - F.col("_start") >= F.lit(dur))
                .select(*keys, from_us("_start", like).alias("run_start"),
                        from_us(F.col("_start") + F.lit(dur), like).alias("alarm_ts")))


def _single(seq: DataFrame, keys, order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    run_w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rise = F.coalesce(F.col("_v") > F.lag("_v").over(w), F.lit(False))
    seq = seq.withColumn("_rise", rise).withColumn("_nxt", F.lead("_us").over(w))
    # a rising row's run starts at the row right after the latest break
    start = F.last(F.when(~F.col("_rise"), F.col("_nxt")), ignorenulls=True).over(run_w)
    return seq.withColumn("_start", start).where("_rise")


def _bucketed(seq: DataFrame, keys, order, width: int) -> DataFrame:
    # One explicit shuffle by (key, bucket): the bucket summaries and the rows
    # they are joined back to both derive from it, so the input is read once.
    seq = (seq.withColumn("_b", F.floor(F.col("_us") / F.lit(width)).cast("long"))
              .repartition(*keys, "_b"))
    wb = Window.partitionBy(*keys, "_b").orderBy(*order)
    a = (seq.withColumn("_rn", F.row_number().over(wb))
            .withColumn("_lagv", F.lag("_v").over(wb))
            .withColumn("_nxt", F.lead("_us").over(wb))
            .withColumn("_lbrk", (F.col("_rn") > 1) & ~F.coalesce(F.col("_v") > F.col("_lagv"), F.lit(False))))

    # 1. one summary row per (key, bucket)
    s = (a.groupBy(*keys, "_b").agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(F.when(F.col("_rn") == 1, F.col("_us"))).alias("_first_us"),
            F.max(F.when(F.col("_rn") == 1, F.col("_v"))).alias("_first_v"),
            F.max(F.when(F.col("_rn") == 2, F.col("_us"))).alias("_second_us"),
            F.max_by("_v", "_rn").alias("_last_v"),
            F.max_by("_lbrk", "_rn").alias("_last_lbrk"),
            F.max(F.col("_lbrk").cast("int")).alias("_has_lbrk"),
            F.max_by("_nxt", F.when(F.col("_lbrk"), F.col("_rn"))).alias("_open_local")))

    # 2. carry across a key's buckets
    wk = Window.partitionBy(*keys).orderBy("_b")
    upto = wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first_rise = F.coalesce(F.col("_first_v") > F.lag("_last_v").over(wk), F.lit(False))
    s = s.withColumn("_first_rise", first_rise)
    resetting = (F.col("_has_lbrk") == 1) | ~F.col("_first_rise")
    # run open at the end of a bucket that decides it alone (null: it ends with a break)
    own_end = (F.when(F.col("_has_lbrk") == 1,
                      F.when(F.col("_last_lbrk"), F.lit(None).cast("long")).otherwise(F.col("_open_local")))
                .otherwise(F.when(F.col("_n") >= 2, F.col("_second_us"))))
    s = (s.withColumn("_reset", resetting)
          .withColumn("_own_end", own_end)
          .withColumn("_next_first", F.lead("_first_us").over(wk)))
    from_reset = F.last(F.when(F.col("_reset"), F.struct(F.col("_own_end").alias("e"),
                                                          F.col("_next_first").alias("nf"))),
                        ignorenulls=True).over(upto)
    s = s.withColumn("_end", F.when(F.col("_reset"), F.col("_own_end"))
                     .otherwise(F.coalesce(from_reset["e"], from_reset["nf"])))
    # start of the run entering a bucket, used when its first row rises
    s = s.withColumn("_carry", F.coalesce(F.lag("_end").over(wk), F.col("_first_us")))
    carry = s.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_b").alias("_c_b"),
                     "_first_rise", "_carry")

    # 3. back to the rows
    # null-safe equality infers no not-null filter, so both sides keep the
    # identical shuffle underneath and Spark reuses it (one read of the input)
    cond = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_b").eqNullSafe(F.col("_c_b"))]
    j = a.join(carry, cond)
    rise = F.when(F.col("_rn") == 1, F.col("_first_rise")).otherwise(~F.col("_lbrk"))
    upto_b = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("_rise", rise)
    start = F.coalesce(F.last(F.when(~F.col("_rise"), F.col("_nxt")), ignorenulls=True).over(upto_b),
                       F.col("_carry"))
    return j.withColumn("_start", start).where("_rise")


def rising_alarm(df: DataFrame, key, ts: str, value: str, duration="10 seconds",
                 tiebreak: str | None = None, method: str = "buckets", bucket=DEFAULT_BUCKET) -> DataFrame:
    """key columns, ``run_start``, ``alarm_ts`` for every run that alarms."""
    keys = [key] if isinstance(key, str) else list(key)
    dur = duration_us(duration)
    like = df.schema[ts].dataType
    seq = df.select(*keys, to_us(ts).alias("_us"), F.col(value).alias("_v"),
                    *([F.col(tiebreak).alias("_tb")] if tiebreak else []))
    order = [F.col("_us")] + ([F.col("_tb")] if tiebreak else [])
    if method == "single":
        rises = _single(seq, keys, order)
    elif method == "buckets":
        rises = _bucketed(seq, keys, order, duration_us(bucket))
    else:
        raise ValueError("method must be 'buckets' or 'single'")
    return _alarms(rises, keys, dur, like)

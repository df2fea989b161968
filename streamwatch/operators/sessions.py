"""Session windows (W7): runs of a key's events at most ``gap`` apart.

Two levels, as the patterns: rows are shuffled once by (key, time bucket) and cut
into runs there. A run between others of its bucket is a session as it stands; the
first and last of each bucket may go on in its neighbours, so those, two rows a
bucket at most, are merged over the key. A hot key's events are spread over its
buckets, and no group grows with the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import duration_us, from_us, to_us, ts_type
from .patterns import _as_list, _by_bucket


def sessions(df: DataFrame, key, ts: str, gap, bucket="1 day") -> DataFrame:
    """Key columns, session_start, session_end (last event + ``gap``, exclusive) and n.

    An event exactly ``gap`` after the one before still belongs to its session, as in
    Spark's ``session_window``. Rows with a null time take no part; null keys form one key.
    """
    keys, width = _as_list(key), duration_us(gap)
    if width <= 0:
        raise ValueError("gap must be positive")
    like = ts_type(df, ts)
    rows = _by_bucket(df.where(F.col(ts).isNotNull()).select(*keys, ts), keys, ts, bucket).select(*keys, "_b", to_us(ts).alias("_us"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_us")
    fresh = F.coalesce(F.col("_us") - F.lag("_us").over(inside) > F.lit(width), F.lit(True)).cast("long")
    rows = rows.withColumn("_fresh", fresh)
    rows = rows.withColumn("_run", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy(*keys, "_b", "_run").agg(F.min("_us").alias("_start"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("_runs", F.max("_run").over(Window.partitionBy(*keys, "_b")))
    border = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    along = Window.partitionBy(*keys).orderBy("_start")
    # a run that does not reach back to the one before begins a session; whole runs stay as they are
    begins = F.coalesce(F.col("_start") - F.lag("_last").over(along) > F.lit(width), F.lit(True)).cast("long")
    chains = runs.where(border).withColumn("_fresh", begins)
    chains = chains.withColumn("_chain", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = chains.groupBy(*keys, "_chain").agg(F.min("_start").alias("_start"), F.max("_last").alias("_last"), F.sum("n").alias("n"))
    cols = [*keys, "_start", "_last", "n"]
    return runs.where(~border).select(cols).unionByName(merged.select(cols)).select(
        *keys, from_us("_start", like).alias("session_start"), from_us(F.col("_last") + F.lit(width), like).alias("session_end"), "n")

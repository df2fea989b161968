"""Time buckets that split a key's rows across tasks.

A time-range join becomes an equi-join on ``(key, bucket)`` plus the range
test: one side goes to its own bucket, the other to every bucket its range
touches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import to_us


def home_bucket(ts: str, width_us: int) -> Column:
    return F.floor(to_us(ts) / F.lit(width_us)).cast("long")


def range_buckets(ts: str, lower_us: int, upper_us: int, width_us: int) -> Column:
    """Every bucket that [t + lower, t + upper] touches (an array to explode)."""
    us = to_us(ts)
    lo = F.floor((us + F.lit(lower_us)) / F.lit(width_us)).cast("long")
    hi = F.floor((us + F.lit(upper_us)) / F.lit(width_us)).cast("long")
    return F.sequence(lo, hi)

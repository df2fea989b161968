"""Event-time helpers (P3).

All arithmetic on event time is done on epoch microseconds (``bigint``).
Pane and bucket numbers are ``floor(us / width)`` computed in double
precision, which is exact: a non-integer quotient lies at least ``1 / width``
from an integer, more than half an ulp while ``us < 2^53`` (until the year
2255); results are converted back to the
caller's timestamp type (``timestamp`` or ``timestamp_ntz``). The session time
zone must be UTC (see ``streamwatch.session``) so the ``timestamp_ntz`` <->
``timestamp`` casts are the identity on wall-clock values.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000,
}
_ABBR = {"us": "microsecond", "ms": "millisecond", "s": "second", "sec": "second", "m": "minute",
         "min": "minute", "h": "hour", "d": "day", "w": "week"}


def duration_us(d) -> int:
    """'1 hour', '5 seconds', '90s', a timedelta, or seconds as a number -> microseconds."""
    if isinstance(d, timedelta):
        return int(d / timedelta(microseconds=1))
    if isinstance(d, (int, float)):
        return int(round(d * 1_000_000))
    total = 0
    parts = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", str(d))
    if not parts:
        raise ValueError(f"cannot parse duration {d!r}")
    for num, unit in parts:
        u = unit.lower()
        u = _ABBR.get(u, u.rstrip("s"))
        if u not in _UNITS:
            raise ValueError(f"unknown unit {unit!r} in {d!r}")
        total += float(num) * _UNITS[u]
    return int(round(total))


def interval_literal(d) -> str:
    """Microseconds rendered as a Spark/DuckDB interval string ('3600 seconds')."""
    us = duration_us(d)
    if us % 1_000_000 == 0:
        return f"{us // 1_000_000} seconds"
    return f"{us} microseconds"


def to_us(c) -> Column:
    """Event time column (timestamp, timestamp_ntz) -> epoch microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def from_us(c, like: T.DataType | None = None) -> Column:
    """Epoch microseconds -> timestamp of the same kind as ``like``."""
    c = F.col(c) if isinstance(c, str) else c
    ts = F.timestamp_micros(c)
    if isinstance(like, T.TimestampNTZType):
        return ts.cast("timestamp_ntz")
    return ts


def ts_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def with_event_time(df: DataFrame, col: str, out: str = "ts", unit: str = "s",
                    delay=None) -> DataFrame:
    """Make ``out`` a ``timestamp`` event-time column and optionally set a watermark.

    ``col`` may be epoch seconds / millis (``unit``), a ``timestamp`` or a
    ``timestamp_ntz``; streams need ``timestamp`` for ``withWatermark``.
    """
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.LongType, T.IntegerType, T.DoubleType, T.DecimalType)):
        c = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit](c)
    else:
        c = c.cast("timestamp")
    df = df.withColumn(out, c)
    if delay is not None:
        df = df.withWatermark(out, interval_literal(delay))
    return df


def with_delay(df: DataFrame, ts: str, delay) -> DataFrame:
    """``df`` with a watermark on ``ts``; ``delay=None``: it already carries one."""
    if delay is None:
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, interval_literal(delay))


def after_watermark(pred: Column, ts: str) -> Column:
    """A filter that stays above the watermark on ``ts``, so the rows it drops still move event time.

    The optimizer moves a filter below the watermark unless it refers to the event time in
    one unsplit expression. Rows where ``pred`` is null are dropped, as by a plain filter.
    """
    return F.coalesce(pred, F.year(F.col(ts)) < F.lit(-9999))


def day_of(c) -> Column:
    """Calendar day (UTC) of an event time."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c)

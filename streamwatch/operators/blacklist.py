"""Click-fraud blacklist (K3): job 3.6.

Within one ``scope`` (UTC calendar day by default) the first ``limit`` clicks
of a (user, ad) group pass; click ``limit + 1`` raises one alert and it and
every later click of the group in that scope are filtered out. Order is event
time, then ``tiebreak``. Duplicate rows count as clicks.

Plan, built for a group that may hold a third of all rows: one
``row_number() over (partition by group order by ts, tiebreak)`` filtered to
``<= limit + 1``. Catalyst turns that filter into a two-step group limit
(``WindowGroupLimit Partial`` in each map task before the shuffle, ``Final``
after it), so the task that ranks a hot group receives at most ``limit + 1``
rows per map task. Rows of small groups pass through the same limit
untouched, so no separate count or join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import day_of
from .topn import ensure_group_limit


def click_blacklist(df: DataFrame, keys: list[str], ts: str, limit: int = 100, scope: str | None = "day",
                    tiebreak: str | None = None,
                    scope_col: str = "day") -> tuple[DataFrame, DataFrame]:
    """Returns (kept rows with ``scope_col`` added, alerts).

    alerts: keys, ``scope_col``, ``alert_ts`` (time of click ``limit + 1``)
    and ``alert_<tiebreak>`` when a tiebreak is given.
    """
    keys = list(keys)
    if scope == "day":
        df = df.withColumn(scope_col, day_of(ts))
    elif scope is None:
        df = df.withColumn(scope_col, F.lit(None).cast("date"))
    else:
        raise ValueError("scope must be 'day' or None")
    grp = [*keys, scope_col]
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    ensure_group_limit(df.sparkSession, limit + 1)
    w = Window.partitionBy(*grp).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit + 1)

    kept = ranked.where(F.col("_rank") <= limit).drop("_rank")
    alerts = ranked.where(F.col("_rank") == limit + 1).select(
        *grp, F.col(ts).alias("alert_ts"),
        *([F.col(tiebreak).alias(f"alert_{tiebreak}")] if tiebreak else []))
    return kept, alerts

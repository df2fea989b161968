"""Top-N per window (A3): the second keyBy + KeyedProcessFunction of jobs 3.1 / 3.2.

Ranking is by count descending, then key ascending, and exactly N rows per
window are kept (``row_number``, not ``rank``).

One window can hold millions of keys. ``row_number() <= N`` lets Catalyst
plan a two-step group limit: a ``WindowGroupLimit Partial`` in every map task
keeps only its top N per window before the shuffle, so the task that ranks a
window receives at most ``N`` rows per map task, never the whole window. This
needs ``N <= spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by
default); ``window_topn`` raises the threshold for larger N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def ensure_group_limit(spark, n: int) -> None:
    """Make sure a ``row_number() <= n`` filter is planned with a partial group limit."""
    cur = int(spark.conf.get(GROUP_LIMIT_CONF, "1000"))
    if n > cur:
        spark.conf.set(GROUP_LIMIT_CONF, str(n))


def window_topn(counts: DataFrame, n: int, key_cols: list[str], part_cols=("window_start",),
                order_col: str = "n", rank_col: str = "rank") -> DataFrame:
    ensure_group_limit(counts.sparkSession, n)
    order = [F.col(order_col).desc(), *[F.col(k).asc() for k in key_cols]]
    w = Window.partitionBy(*part_cols).orderBy(*order)
    return counts.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)

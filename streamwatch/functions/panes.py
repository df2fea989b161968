"""

A sliding window of ``size`` advancing every ``slide`` (``size % slide == 0``)
is the sum of ``k = size / slide`` consecutive panes of length ``slide``.
Spark's native ``window(ts, size, slide)`` expands *every event* into ``k``
rows through a ``k``-way Expand (720 projections for 1 h / 5 s, which also
compiles slowly). Here each event is counted once into its pane (hash
aggregate with map-side combine), and the pane totals are turned into window
totals by one of two plans:

``sweep`` (default). Number window starts in pane units. Pane ``p`` with
total ``c`` is inside windows ``p - k + 1 .. p``, so it adds ``+c`` at
position ``p - k + 1`` and ``-c`` at ``p + 1``. A running sum over a key's
sorted boundary positions is the window total, constant between two
neighbouring boundaries; each positive segment is exploded straight into its
output rows. Work is O(panes + output rows) and nothing is aggregated after
the explode. By default the running sum is a window per key, whose group is
at most two boundaries per pane of the key (bounded by time span / slide,
not by event count). With ``block=B`` it is taken per (key, block of B
positions) and shifted by a carry, the sum of the key's earlier blocks (a
window over one summary row per block), so no group exceeds one block: the
choice for few keys over long spans, where one group per key would limit
the stage to as many tasks as keys.

``fanout``. Each pane total is copied to its ``k`` window starts and summed
by hash aggregation, in two levels ``k = b * m`` for large ``k``:

    S[t] = sum_{r < b} c[t + r]          (each pane fans out b times)
    W[w] = sum_{q < m} S[w + q * b]      (each partial sum fans out m times)

Simple, but when windows rarely share panes (sparse keys) the final
aggregate sees as many groups as rows, which is the slow case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .combine import SUM, slide_combined
from .time import duration_us, to_us

# Above this many panes per window the fan-out uses the two-level form.
TWO_LEVEL_MIN_PANES = 64
# Boundary positions per running-sum group of a blocked sweep (65,536 panes: 3.8 days of 5 s panes).
SWEEP_BLOCK = 1 << 16


def pane_index(ts, slide_us: int) -> Column:
    """Pane number of an event time: floor(epoch_us / slide)."""
    return F.floor(to_us(ts) / F.lit(slide_us)).cast("long")


def split_factor(k: int) -> int:
    """The divisor of k closest to sqrt(k) (1 when k is prime or small)."""
    if k < TWO_LEVEL_MIN_PANES:
        return 1
    root = math.sqrt(k)
    best = 1
    for d in range(1, int(root) + 2):
        if k % d == 0:
            for cand in (d, k // d):
                if abs(cand - root) < abs(best - root):
                    best = cand
    return best


def _fan(df: DataFrame, keys: list[str], pane: str, n: str, width: int, step: int) -> DataFrame:
    """Sum ``n`` of panes p into starts p - j*step for j in [0, width)."""
    if width == 1:
        return df
    starts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                         lambda j: F.col(pane) - j * F.lit(step))
    fanned = df.select(*keys, F.explode(starts).alias(pane), F.col(n))
    return fanned.groupBy(pane, *keys).agg(F.sum(n).alias(n))


def sweep(panes: DataFrame, keys: list[str], k: int, pane: str = "pane", n: str = "n",
          block: int | None = None) -> DataFrame:
    """Window totals from pane totals by a boundary sweep (see module doc).

    ``block=None``: one running sum per key (best when there are many keys).
    ``block=B``: running sums per (key, B boundary positions) plus a carry,
    for few keys over long time spans.
    """
    # beside the measure run the number of panes in the window, which says whether it
    # exists, and of panes with a value, without which the total is null (as in SQL)
    kind = panes.schema[n].dataType
    if isinstance(kind, (FloatType, DoubleType)):
        raise ValueError("running sums of floating-point measures drift; use slide_combined")
    val = F.coalesce(F.col(n), F.lit(0).cast(kind))
    has = F.col(n).isNotNull().cast("long")
    one = F.lit(1).cast("long")
    bounds = F.array(
        F.struct((F.col(pane) - F.lit(k - 1)).alias("pos"), val.alias("d"), one.alias("o"), has.alias("v")),
        F.struct((F.col(pane) + F.lit(1)).alias("pos"), (-val).cast(kind).alias("d"), (-one).alias("o"), (-has).alias("v")))
    return sweep_bounds(panes.select(*keys, F.inline(bounds)), keys, pane, n, block)


def sweep_bounds(bounds: DataFrame, keys: list[str], pane: str = "pane", n: str = "n", block: int | None = None) -> DataFrame:
    """Totals per window start from boundary rows (keys, pos, d, o, v): from ``pos`` on the total
    changes by ``d``, the number of contributions by ``o`` and that of values by ``v``.

    Starts with at least one contribution appear; without a value their total is null.
    """
    run = ("d", "o", "v")
    d = bounds.groupBy(*keys, "pos").agg(*[F.sum(c).alias(c) for c in run])
    out = F.when(F.col("_v") > 0, F.col("_d")).alias(n)
    starts = F.explode(F.sequence(F.col("pos"), F.col("_end") - 1)).alias(pane)
    if block is None:
        w = Window.partitionBy(*keys).orderBy("pos")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seg = d.select(*keys, "pos", *[F.sum(c).over(upto).alias(f"_{c}") for c in run],
                       F.lead("pos").over(w).alias("_end")).where("_o > 0")
        return seg.select(*keys, starts, out)
    d = d.withColumn("_blk", F.floor(F.col("pos") / F.lit(block)).cast("long"))
    # running sum and next boundary within (key, block)
    wb = Window.partitionBy(*keys, "_blk").orderBy("pos")
    upto = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select(*keys, "_blk", "pos", *[F.sum(c).over(upto).alias(f"_run_{c}") for c in run],
                 F.lead("pos").over(wb).alias("_next"))
    # per block: its total (the running sum at its last boundary, a window output, so both
    # branches keep the same window and Spark reuses its shuffle) and its first boundary;
    # per key over blocks: the carry in from earlier blocks and the next block's first boundary
    wk = Window.partitionBy(*keys).orderBy("_blk")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    summ = (d.groupBy(*keys, "_blk").agg(*[F.max_by(f"_run_{c}", "pos").alias(f"_tot_{c}") for c in run],
                                         F.min("pos").alias("_first"))
             .select(*[F.col(c).alias(f"_s_{c}") for c in keys], F.col("_blk").alias("_s_blk"),
                     *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_carry_{c}") for c in run],
                     F.lead("_first").over(wk).alias("_next_first")))
    # null-safe keys: no not-null filter is inferred below the join, so the shuffle is shared
    cond = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys] + [F.col("_blk").eqNullSafe(F.col("_s_blk"))]
    seg = (d.join(summ, cond)
            .select(*keys, "pos", *[(F.col(f"_run_{c}") + F.col(f"_carry_{c}")).alias(f"_{c}") for c in run],
                    F.coalesce("_next", "_next_first").alias("_end"))
            .where("_o > 0"))
    # a window that holds a pane always has a later boundary at which that pane leaves
    return seg.select(*keys, starts, out)


def slide_panes(panes: DataFrame, keys: list[str], k: int, pane: str = "pane",
                n: str = "n", method: str = "sweep", block: int | None = None) -> DataFrame:
    """Pane totals -> totals of every window of ``k`` panes, keyed by its first pane.

    ``panes`` has one row per (pane, keys) with an additive measure ``n``.
    The result has the same columns; ``pane`` now names the window's first
    pane. Only windows with at least one contributing pane appear; a total may be
    zero, negative, or null (no value in the window). Floating-point measures are
    combined (``functions.combine``) instead of swept: running sums would carry rounding
    errors along. Its groups are bounded by ``k`` panes, so ``block`` says nothing there.
    """
    if k == 1:
        return panes
    if method == "sweep":
        if isinstance(panes.schema[n].dataType, (FloatType, DoubleType)):
            return slide_combined(panes, keys, k, {n: SUM}, pane).select(panes.columns)
        return sweep(panes, keys, k, pane, n, block)
    b = split_factor(k)
    if b == 1 or b == k:
        return _fan(panes, keys, pane, n, k, 1)
    m = k // b
    partial = _fan(panes, keys, pane, n, b, 1)
    return _fan(partial, keys, pane, n, m, b)


def pane_counts(df: DataFrame, ts: str, keys: list[str], slide, weight: str | None = None,
                pane: str = "pane", n: str = "n") -> DataFrame:
    """Count (or sum ``weight``, in its own type) per (pane, keys)."""
    slide_us = duration_us(slide)
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (df.select(pane_index(ts, slide_us).alias(pane), *keys,
                      *([F.col(weight)] if weight else []))
              .groupBy(pane, *keys).agg(measure.alias(n)))

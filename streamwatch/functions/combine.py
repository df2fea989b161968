"""Sliding windows of measures that cannot be subtracted: min, max, sums of doubles, sketches.

A window of ``k`` panes touches two neighbouring blocks of ``k`` panes: a tail of
the one it starts in and a head of the next. With running combinations of each
block's panes from either end, any window is the combination of two values, so
a pane costs a few rows and not ``k``, and nothing is taken away again (a sum
of doubles does not drift, and no inverse of min, max or a sketch is needed).

The window's content changes only where a pane enters (first window start
``p - k + 1``) or leaves (``p + 1``). Those starts, and the first start of a
block that is reached from the one before, are the boundaries; between two of
them the value is constant, and each stretch is exploded into its rows at the end.

Every group of the plan is one key's block: at most ``k`` panes and their
boundaries, whatever the time span and however many events a key has.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Combine(NamedTuple):
    """How pane values combine: ``many`` is an aggregate that skips nulls, ``two`` takes two non-null values."""

    many: Callable[[Column], Column]
    two: Callable[[Column, Column], Column]


MIN = Combine(F.min, F.least)
MAX = Combine(F.max, F.greatest)
SUM = Combine(F.sum, lambda a, b: a + b)
KLL_DOUBLE = Combine(F.kll_merge_agg_double, F.kll_sketch_merge_double)
HLL = Combine(F.hll_union_agg, F.hll_union)


def _either(combine: Combine, a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine.two(a, b))


def slide_combined(panes: DataFrame, keys: list[str], k: int, measures: dict[str, Combine], pane: str = "pane") -> DataFrame:
    """Pane values -> values of every window of ``k`` panes that holds a pane, keyed by its first pane.

    ``panes`` has one row per (pane, keys) with the columns of ``measures``; so has
    the result. A null value says nothing; a window of nulls alone has null. Three
    shuffles of a few rows a pane: none grows with ``k`` but the result.
    """
    if k == 1:
        return panes.select(*keys, pane, *measures)
    p, width = F.col(pane), F.lit(k).cast("long")
    block = lambda pos: F.floor(pos / width).cast("long")
    nothing = {m: F.lit(None).cast(panes.schema[m].dataType) for m in measures}

    def entry(blk: Column, pos: Column, kind: int, start: Column, values: dict[str, Column]) -> Column:
        return F.struct(blk.alias("_blk"), pos.alias("_pos"), F.lit(kind).alias("_kind"), start.alias("_w"),
                        *[v.alias(f"_m_{m}") for m, v in values.items()])

    first = p - width + 1
    starts = F.array_distinct(F.array(first, (block(first) + 1) * width, p + 1))
    rows = F.concat(F.array(entry(block(p), p, 0, F.lit(None).cast("long"), {m: F.col(m) for m in measures})),
                    F.transform(starts, lambda w: entry(block(w), w, 1, w, nothing)),
                    F.transform(starts, lambda w: entry(block(w) + 1, w + width - 1, 2, w, nothing)))
    rows = panes.select(*keys, F.inline(rows))
    tail = Window.partitionBy(*keys, "_blk").orderBy(F.col("_pos").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    head = Window.partitionBy(*keys, "_blk").orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_pane = F.when(F.col("_kind") == 0, F.lit(1))
    found = rows.select(*keys, "_kind", "_w", F.count(is_pane).over(tail).alias("_t"), F.count(is_pane).over(head).alias("_h"),
                        *[c.many(F.col(f"_m_{m}")).over(tail).alias(f"_t_{m}") for m, c in measures.items()],
                        *[c.many(F.col(f"_m_{m}")).over(head).alias(f"_h_{m}") for m, c in measures.items()]).where("_kind > 0")
    # a start that several panes name has the same two values each time
    of = lambda kind, c: F.first(F.when(F.col("_kind") == kind, F.col(c)), ignorenulls=True)
    both = (found.withColumn("_blk", block(F.col("_w"))).repartition(*keys, "_blk").groupBy(*keys, "_blk", "_w")
            .agg(F.coalesce(of(1, "_t"), F.lit(0)).alias("_t"), F.coalesce(of(2, "_h"), F.lit(0)).alias("_h"),
                 *[of(1, f"_t_{m}").alias(f"_t_{m}") for m in measures], *[of(2, f"_h_{m}").alias(f"_h_{m}") for m in measures]))
    after = F.lead("_w").over(Window.partitionBy(*keys, "_blk").orderBy("_w"))
    stretches = both.withColumn("_end", F.coalesce(after, (F.col("_blk") + 1) * width)).where(F.col("_t") + F.col("_h") > 0)
    return stretches.select(*keys, F.explode(F.sequence(F.col("_w"), F.col("_end") - 1)).alias(pane),
                            *[_either(c, F.col(f"_t_{m}"), F.col(f"_h_{m}")).alias(m) for m, c in measures.items()])

"""Windowed aggregation: counts per key (A1/A2), PV (A4), UV exact (A5) and by sketch (A6).

Windows are ``[start, end)``, aligned to the epoch, in UTC. Every result
carries ``window_start`` / ``window_end`` in the event-time column's type.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bloom import BITS, HASHES, bitmap_positions, bloom_estimate, whole_number
from ..functions.combine import KLL_DOUBLE, MAX, MIN, SUM, slide_combined
from ..functions.panes import pane_counts, pane_index, slide_panes, sweep_bounds
from ..functions.time import duration_us, from_us, interval_literal, ts_type

# Sliding windows with at most this many overlaps may use Spark's own window().
NATIVE_MAX_OVERLAP = 1


def window_count(df: DataFrame, ts: str, keys: list[str], size, slide=None,
                 weight: str | None = None, out: str = "n", method: str = "auto",
                 plan: str = "sweep", block: int | None = None) -> DataFrame:
    """Count events (or sum an additive ``weight``) per window and key.

    ``method``: ``native`` uses ``F.window``; ``panes`` counts each event into
    one pane and fans pane totals out to windows (see functions.panes);
    ``auto`` uses panes for any sliding window whose size is a multiple of the
    slide and ``F.window`` otherwise.
    """
    size_us = duration_us(size)
    slide_us = size_us if slide is None else duration_us(slide)
    k, rem = divmod(size_us, slide_us)
    like = ts_type(df, ts)
    if method == "auto":
        method = "panes" if (rem == 0 and k > NATIVE_MAX_OVERLAP) else "native"
    if method == "native" or (k == 1 and rem == 0):
        w = (F.window(ts, interval_literal(size)) if slide is None or k == 1
             else F.window(ts, interval_literal(size), interval_literal(slide)))
        measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
        return (df.groupBy(w.alias("w"), *keys).agg(measure.alias(out))
                  .select(F.col("w.start").alias("window_start"),
                          F.col("w.end").alias("window_end"), *keys, out))
    if rem != 0:
        raise ValueError("pane method needs size to be a multiple of slide")
    panes = pane_counts(df, ts, keys, timedelta(microseconds=slide_us), weight=weight, n=out)
    wins = slide_panes(panes, keys, k, n=out, method=plan, block=block)
    start = F.col("pane") * F.lit(slide_us)
    return wins.select(from_us(start, like).alias("window_start"),
                       from_us(start + F.lit(size_us), like).alias("window_end"),
                       *keys, F.col(out))


def windows_from_panes(panes: DataFrame, keys: list[str], size, slide=None, like=None,
                       out: str = "n", plan: str = "sweep", block: int | None = None) -> DataFrame:
    """Pane totals (``pane``, keys, ``out``) -> per-window totals with bounds.

    Lets a job pre-aggregate per pane before a join (which shrinks the join
    input) and window afterwards.
    """
    size_us = duration_us(size)
    slide_us = size_us if slide is None else duration_us(slide)
    k, rem = divmod(size_us, slide_us)
    if rem:
        raise ValueError("size must be a multiple of slide")
    wins = slide_panes(panes, keys, k, n=out, method=plan, block=block)
    start = F.col("pane") * F.lit(slide_us)
    return wins.select(from_us(start, like).alias("window_start"),
                       from_us(start + F.lit(size_us), like).alias("window_end"),
                       *keys, F.col(out))


#: Aggregates of ``window_aggregate``: of a pane's rows, and how panes combine.
_PANE_AGGS = {"count": (F.count, SUM), "sum": (F.sum, SUM), "min": (F.min, MIN), "max": (F.max, MAX)}


def window_aggregate(df: DataFrame, ts: str, keys: list[str], size, slide=None, **aggs: tuple[str, str]) -> DataFrame:
    """Any of count, sum, min, max and avg per window and key: ``low=("min", "value")``.

    Rows are aggregated once into their panes (map-side combine), panes into windows
    by combining (``functions.combine``), so no measure needs an inverse and nothing
    fans out. Nulls are skipped; a window of nulls alone has count 0 and null else.
    The result carries the window's bounds, so what is to be computed from the
    whole window's values and its bounds is a further expression over the row.
    """
    size_us = duration_us(size)
    slide_us = size_us if slide is None else duration_us(slide)
    k, rem = divmod(size_us, slide_us)
    if rem:
        raise ValueError("size must be a multiple of slide")
    like = ts_type(df, ts)
    needs: dict[str, tuple[str, str]] = {}
    for kind, col in aggs.values():
        for part in ("sum", "count") if kind == "avg" else (kind,):
            needs[f"_{part}_{col}"] = (part, col)
    unknown = [part for part, _ in needs.values() if part not in _PANE_AGGS]
    if unknown:
        raise ValueError(f"unknown aggregate {unknown[0]!r}")
    cols = list(dict.fromkeys(c for _, c in needs.values()))
    panes = (df.select(pane_index(ts, slide_us).alias("pane"), *keys, *[c for c in cols if c not in keys])
             .groupBy("pane", *keys).agg(*[_PANE_AGGS[part][0](c).alias(n) for n, (part, c) in needs.items()]))
    wins = slide_combined(panes, keys, k, {n: _PANE_AGGS[part][1] for n, (part, _) in needs.items()})
    start = F.col("pane") * F.lit(slide_us)

    def value(kind: str, col: str) -> Column:
        if kind != "avg":
            return F.col(f"_{kind}_{col}")
        return F.when(F.col(f"_count_{col}") > 0, F.col(f"_sum_{col}") / F.col(f"_count_{col}"))

    return wins.select(from_us(start, like).alias("window_start"), from_us(start + F.lit(size_us), like).alias("window_end"),
                       *keys, *[value(*spec).alias(name) for name, spec in aggs.items()])


def window_quantiles(df: DataFrame, ts: str, keys: list[str], size, slide, value: str, quantiles: dict[str, float],
                     lg_k: int = 200) -> DataFrame:
    """Quantiles of ``value`` per window and key from mergeable KLL sketches, one a pane.

    ``n`` values up to ``lg_k`` keep the sketch whole and its quantiles exact: the
    smallest value whose rank is at least ``q * n``. Beyond, the rank is wrong by
    about 1.7 / ``lg_k`` of ``n`` at most, with 99 % confidence. Null values are skipped.
    """
    size_us, slide_us = duration_us(size), duration_us(slide)
    if size_us % slide_us:
        raise ValueError("size must be a multiple of slide")
    like = ts_type(df, ts)
    v = F.col(value).cast("double")
    panes = (df.select(pane_index(ts, slide_us).alias("pane"), *keys, v.alias("_v")).where("_v is not null").groupBy("pane", *keys)
             .agg(F.kll_sketch_agg_double("_v", F.lit(lg_k)).alias("_s"), F.count("_v").alias("n")))
    wins = slide_combined(panes, keys, size_us // slide_us, {"_s": KLL_DOUBLE, "n": SUM})
    start = F.col("pane") * F.lit(slide_us)
    return wins.select(from_us(start, like).alias("window_start"), from_us(start + F.lit(size_us), like).alias("window_end"), *keys, "n",
                       *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(name) for name, q in quantiles.items()])


def sliding_uv(df: DataFrame, ts: str, user: str, size, slide, keys: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Exact distinct users per sliding window (and key), without a copy of a row for each window.

    A user's pane ``p`` adds them to the windows ``p - k + 1 .. p``, less those that
    their pane before already covers; these intervals are disjoint, so +1 and -1 at
    their ends, summed up in order, count each user once a window. Panes of a user
    are looked at in blocks of time, each with the panes before it that still reach
    into it, so a hot user is divided. Null users do not count; windows without any
    user do not appear.
    """
    keys = list(keys or [])
    size_us, slide_us = duration_us(size), duration_us(slide)
    k, rem = divmod(size_us, slide_us)
    if rem:
        raise ValueError("size must be a multiple of slide")
    like = ts_type(df, ts)
    reach = max(k, 4096)
    p = F.col("pane")
    seen = df.where(F.col(user).isNotNull()).select(*keys, F.col(user).alias("_user"), pane_index(ts, slide_us).alias("pane")).distinct()
    home = F.floor(p / F.lit(reach)).cast("long")
    seen = seen.select("*", home.alias("_home"), F.explode(F.array_distinct(F.array(home, F.floor((p + (k - 1)) / F.lit(reach)).cast("long")))).alias("_blk"))
    before = F.lag("pane").over(Window.partitionBy(*keys, "_user", "_blk").orderBy("pane"))
    since = seen.withColumn("_since", F.greatest(p - (k - 1), before + 1)).where("_blk = _home")
    one = F.lit(1).cast("long")
    ends = F.array(F.struct(F.col("_since").alias("pos"), one.alias("d"), one.alias("o"), one.alias("v")),
                   F.struct((p + 1).alias("pos"), (-one).alias("d"), (-one).alias("o"), (-one).alias("v")))
    wins = sweep_bounds(since.select(*keys, F.inline(ends)), keys, "pane", "uv", block)
    start = F.col("pane") * F.lit(slide_us)
    return wins.select(from_us(start, like).alias("window_start"), from_us(start + F.lit(size_us), like).alias("window_end"), *keys, "uv")


def bloom_slices(df: DataFrame, window: str, user: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(window, _slice, _set, _rows): bits set in each slice of a window's filter, and the rows counted there."""
    member = whole_number(F.col(user), df.schema[user].dataType.simpleString())
    places = df.select(window, F.posexplode(bitmap_positions(member, bits, hashes)).alias("_i", "_bit"))
    return (places.groupBy(window, F.bitmap_bucket_number("_bit").alias("_slice"))
            .agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("_bit"))).alias("_set"),
                 F.sum((F.col("_i") == 0).cast("long")).alias("_rows")))


def uv_bloom(df: DataFrame, ts: str, user: str, size="1 hour", bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """PV and UV per tumbling window by a Bloom filter: UV follows from the share of bits set.

    Users set ``hashes`` of ``bits`` bits. The filter is kept in slices of 32,768
    bits (4 KB), each built by map-side combining and only if a bit in it is set, so
    memory for each window is bounded whatever the number of users, and no user id
    is shuffled. See ``functions.bloom`` for the estimate and its error.
    """
    return (bloom_slices(_tumble(df, ts, size), "_w", user, bits, hashes)
            .groupBy("_w").agg(F.sum("_rows").alias("pv"), F.sum("_set").alias("_set"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "pv",
                    bloom_estimate(F.col("_set"), bits, hashes).alias("uv")))


def _tumble(df: DataFrame, ts: str, size) -> DataFrame:
    return df.withColumn("_w", F.window(ts, interval_literal(size)))


def pv(df: DataFrame, ts: str, size="1 hour") -> DataFrame:
    """Page views per tumbling window."""
    return window_count(df, ts, [], size, out="pv")


def pv_uv(df: DataFrame, ts: str, user: str, size="1 hour") -> DataFrame:
    """PV and exact UV per tumbling window.

    ``count(DISTINCT user)`` is planned by Catalyst as a two-step aggregate:
    partial dedupe on (window, user) before the shuffle, then a partial count
    per window, so a hot window or hot user does not pin a task.
    """
    return (_tumble(df, ts, size).groupBy("_w")
            .agg(F.count(F.lit(1)).alias("pv"), F.countDistinct(user).alias("uv"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    "pv", "uv"))


def uv_exact(df: DataFrame, ts: str, user: str, size="1 hour") -> DataFrame:
    return pv_uv(df, ts, user, size).drop("pv")


def uv_approx(df: DataFrame, ts: str, user: str, size="1 hour", lg_k: int = 12,
              keep_sketch: bool = False) -> DataFrame:
    """Approximate UV per tumbling window with a mergeable HLL sketch.

    The alternative to ``uv_bloom`` where a relative error of 1 to 2 % is enough:
    sketches are small and mergeable, so hourly ones roll up to days with ``hll_union_agg``.
    Memory per window is ``2^lg_k`` registers whatever the user count.
    """
    out = (_tumble(df, ts, size).groupBy("_w")
           .agg(F.count(F.lit(1)).alias("pv"), F.hll_sketch_agg(user, lg_k).alias("sketch"))
           .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                   "pv", F.hll_sketch_estimate("sketch").alias("uv"), "sketch"))
    return out if keep_sketch else out.drop("sketch")

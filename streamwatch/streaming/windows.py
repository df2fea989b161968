"""Stream forms of the window jobs (A1-A6, W1-W5): watermarked aggregations in append mode.

The input is a streaming DataFrame *without* a watermark (these functions set
it: Spark refuses a second ``withWatermark`` in one chain) whose event-time
column is a ``timestamp``. A window is emitted once the watermark passes its
end and is never updated afterwards.

Large size/slide ratios (W4, 720 windows per event for 1 h / 5 s) do not use
``window(ts, size, slide)``, whose 720-way Expand is slow to compile and run.
Each event is mapped to its window starts first, the watermark is set on the
start (``size + delay`` behind the newest start), and the aggregation groups
by the start itself.
"""

from __future__ import annotations

from datetime import timedelta

import heapq

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.bloom import BITS, HASHES, bloom_estimate
from ..functions.time import duration_us, interval_literal, to_us, with_delay
from ..operators.windows import bloom_slices

# Above this many windows per event the explode-the-starts form is used.
STREAM_NATIVE_MAX_OVERLAP = 60


class SlidingPanesProcessor(StatefulProcessor):
    """Pane totals of one key -> totals of every ``k``-pane window, emitted once the
    watermark passes the window's end.

    State: the pane totals that can still reach an unemitted window (at most
    ``k`` plus those within the watermark delay) and the first window start
    not yet emitted. One event-time timer sits at the next non-empty window's
    end. Emission walks the windows covered by the stored panes with two
    pointers, so each output row costs O(1).
    """

    def __init__(self, key_names, k: int, slide_us: int):
        self.key_names, self.k, self.slide = list(key_names), k, slide_us

    def init(self, handle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "p long", "n long")
        self.next_w = handle.getValueState("next_w", "w long")

    def _arm(self, stored, next_w) -> None:
        if stored:
            w = max(next_w, min(stored) - self.k + 1)
            self.handle.registerTimer(((w + self.k) * self.slide) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        new = {}
        for r in rows:
            new[r["_pane"]] = new.get(r["_pane"], 0) + r["_n"]
        if not new:
            return iter(())
        next_w = self.next_w.get()[0] if self.next_w.exists() else min(new) - self.k + 1
        for p, n in new.items():
            if p < next_w:  # every window of this pane is already out: late, dropped
                continue
            old = self.panes.getValue((p,))[0] if self.panes.containsKey((p,)) else 0
            self.panes.updateValue((p,), (old + n,))
        self.next_w.update((next_w,))
        self._arm([k[0] for k in self.panes.keys()], next_w)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.next_w.exists():
            return iter(())
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        last_w = wm_us // self.slide - self.k  # windows ending at or before the watermark
        next_w = self.next_w.get()[0]
        panes = sorted((kk[0], vv[0]) for kk, vv in self.panes.iterator())
        out, lo, hi, total = [], 0, 0, 0
        w = next_w
        while panes and w <= last_w:
            # next window that holds a pane: the first pane at or after w starts covering at p - k + 1
            while lo < len(panes) and panes[lo][0] < w:
                total -= panes[lo][1] if lo < hi else 0
                lo += 1
                hi = max(hi, lo)
            if lo == len(panes):
                break
            w = max(w, panes[lo][0] - self.k + 1)
            if w > last_w:
                break
            while hi < len(panes) and panes[hi][0] <= w + self.k - 1:
                total += panes[hi][1]
                hi += 1
            out.append(Row(**dict(zip(self.key_names, key)), _ws=w * self.slide, _n=total))
            w += 1
        next_w = max(next_w, last_w + 1)
        for p, _ in panes:
            if p < next_w:
                self.panes.removeKey((p,))
        self.next_w.update((next_w,))
        self._arm([p for p, _ in panes if p >= next_w], next_w)
        return iter(out)

    def close(self) -> None:
        pass


class SlidingCombineProcessor(StatefulProcessor):
    """Pane values of one key -> values of every ``k``-pane window, for measures without an inverse.

    State: the panes that an unemitted window can still reach (at most ``k`` and
    those within the watermark delay), the first start not yet emitted, and the
    pending timer. A drain reads the panes once and slides over them with two
    stacks: values in front are kept combined from each pane on, those at the back
    as one running value, and the back is turned over when the front is used up. So
    an output row costs a constant number of combinations, and nothing is subtracted.
    """

    def __init__(self, key_names, k: int, slide_us: int, kinds: list[str]):
        self.key_names, self.k, self.slide, self.kinds = list(key_names), k, slide_us, list(kinds)

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"m{i} {kind.split(':')[1]}" for i, kind in enumerate(self.kinds))
        self.panes = handle.getMapState("panes", "p long", fields)
        self.next_w = handle.getValueState("next_w", "w long")
        self.timer = handle.getValueState("timer", "ms long")

    def _two(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        out = []
        for kind, x, y in zip(self.kinds, a, b):
            if x is None or y is None:
                out.append(x if y is None else y)
            else:
                out.append(min(x, y) if kind.startswith("min") else max(x, y) if kind.startswith("max") else x + y)
        return tuple(out)

    def _turned(self, back):
        """The back as a front: the earliest pane on top, each with the combination from it on."""
        front, value = [], None
        for p, v in reversed(back):
            value = self._two(v, value)
            front.append((p, value))
        return front

    def _arm(self, first_pane, next_w) -> None:
        ms = ((max(next_w, first_pane - self.k + 1) + self.k) * self.slide) // 1000
        if not self.timer.exists() or ms < self.timer.get()[0]:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        new = {}
        for r in rows:
            new[r["_pane"]] = self._two(new.get(r["_pane"]), tuple(r[f"_m{i}"] for i in range(len(self.kinds))))
        if not new:
            return iter(())
        if self.next_w.exists():
            next_w = self.next_w.get()[0]
        else:
            next_w = min(new) - self.k + 1
            self.next_w.update((next_w,))
        # the pane aggregation emits a pane once, when it closes, so none comes behind its windows
        for p, v in new.items():
            old = tuple(self.panes.getValue((p,))) if self.panes.containsKey((p,)) else None
            self.panes.updateValue((p,), self._two(old, v))
        self._arm(min(new), next_w)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.next_w.exists():
            return iter(())
        last_w = timerValues.getCurrentWatermarkInMs() * 1000 // self.slide - self.k
        next_w = self.next_w.get()[0]
        if last_w < next_w:
            return iter(())
        panes = sorted((kk[0], tuple(vv)) for kk, vv in self.panes.iterator())
        out, front, back, running = [], [], [], None
        names, at, w = self.key_names, 0, next_w
        while w <= last_w:
            if not front and not back:  # nothing covered: on to the next pane's first window
                while at < len(panes) and panes[at][0] < w:
                    at += 1
                if at == len(panes):
                    break
                w = max(w, panes[at][0] - self.k + 1)
                if w > last_w:
                    break
            while at < len(panes) and panes[at][0] < w + self.k:
                back.append(panes[at])
                running = self._two(running, panes[at][1])
                at += 1
            if not front:
                front, back, running = self._turned(back), [], None
            value = self._two(front[-1][1], running)
            out.append(Row(**dict(zip(names, key)), _ws=w * self.slide, **{f"_m{i}": x for i, x in enumerate(value)}))
            w += 1
            while front and front[-1][0] < w:
                front.pop()
            if not front:  # what lies behind w in the back goes too
                front, back, running = self._turned([x for x in back if x[0] >= w]), [], None
        next_w = last_w + 1
        for p, _ in panes:
            if p < next_w:
                self.panes.removeKey((p,))
        self.next_w.update((next_w,))
        self.timer.clear()
        left = next((p for p, _ in panes if p >= next_w), None)
        if left is not None:
            self._arm(left, next_w)
        return iter(out)

    def close(self) -> None:
        pass


def stream_window_aggregate(df: DataFrame, ts: str, keys: list[str], size, slide=None, delay="0 seconds",
                            **aggs: tuple[str, str]) -> DataFrame:
    """Append-mode count, sum, min, max and avg per window and key, as ``operators.windows.window_aggregate``.

    Spark aggregates each event once into its pane; a per-key ``transformWithState``
    combines closed panes into closed windows. ``window_start`` and ``window_end`` are plain columns.
    """
    size_us = duration_us(size)
    slide_us = size_us if slide is None else duration_us(slide)
    k, rem = divmod(size_us, slide_us)
    if rem:
        raise ValueError("size must be a multiple of slide")
    needs: dict[tuple[str, str], None] = {}
    for kind, col in aggs.values():
        needs.update(dict.fromkeys(((p, col) for p in (("sum", "count") if kind == "avg" else (kind,)))))
    of = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    gkeys = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    pane = F.window(ts, interval_literal(timedelta(microseconds=slide_us))).alias("_pw")
    panes = (with_delay(src, ts, delay).groupBy(pane, *gkeys)
             .agg(*[of[part](col).alias(f"_m{i}") for i, (part, col) in enumerate(needs)])
             .select(*gkeys, (F.unix_micros(F.col("_pw.start")) / F.lit(slide_us)).cast("long").alias("_pane"),
                     *[f"_m{i}" for i in range(len(needs))], F.col("_pw.end").alias("_pane_end")))
    types = [panes.schema[f"_m{i}"].dataType for i in range(len(needs))]
    kinds = [f"{part}:{t.simpleString()}" for (part, _), t in zip(needs, types)]
    schema = T.StructType([src.schema[c] for c in gkeys] + [T.StructField("_ws", T.LongType())]
                          + [T.StructField(f"_m{i}", t) for i, t in enumerate(types)])
    wins = panes.groupBy(*gkeys).transformWithState(SlidingCombineProcessor(gkeys, k, slide_us, kinds), schema, "Append", "EventTime")
    place = {need: F.col(f"_m{i}") for i, need in enumerate(needs)}

    def value(kind, col):
        if kind != "avg":
            return place[kind, col]
        return F.when(place["count", col] > 0, place["sum", col] / place["count", col])

    return wins.select(F.timestamp_micros("_ws").alias("window_start"), F.timestamp_micros(F.col("_ws") + F.lit(size_us)).alias("window_end"),
                       *keys, *[value(*spec).alias(name) for name, spec in aggs.items()])


def stream_window_updates(df: DataFrame, ts: str, keys: list[str], size, slide=None, lateness="1 hour", **aggs: tuple[str, str]) -> DataFrame:
    """Windows as they change, for ``sources.upserts.write_upserts`` (update mode): count, sum, min, max, avg.

    A row up to ``lateness`` behind the newest event corrects its windows, also those
    given out before; state is dropped after that. ``avg`` and the others are Spark's own
    aggregates over ``window(ts, size, slide)``: an event enters ``size / slide`` windows.
    """
    of = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    w = F.window(ts, interval_literal(size), interval_literal(slide or size)).alias("_window")
    return (with_delay(df, ts, lateness).groupBy(w, *keys).agg(*[of[kind](col).alias(name) for name, (kind, col) in aggs.items()])
            .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *aggs))


def _stream_panes(df, ts, keys, size_us, slide_us, k, delay, out):
    gkeys = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    panes = (with_delay(src, ts, delay)
                .groupBy(F.window(ts, interval_literal(timedelta(microseconds=slide_us))).alias("_pw"), *gkeys)
                .agg(F.count(F.lit(1)).alias("_n"))
                .select(*gkeys, (F.unix_micros(F.col("_pw.start")) / F.lit(slide_us)).cast("long").alias("_pane"),
                        "_n", F.col("_pw.end").alias("_pane_end")))
    schema = T.StructType([src.schema[c] for c in gkeys] + [
        T.StructField("_ws", T.LongType()), T.StructField("_n", T.LongType())])
    wins = (panes.groupBy(*gkeys)
            .transformWithState(SlidingPanesProcessor(gkeys, k, slide_us), schema, "Append", "EventTime"))
    start, end = F.timestamp_micros("_ws"), F.timestamp_micros(F.col("_ws") + F.lit(size_us))
    return wins.select(F.struct(start.alias("start"), end.alias("end")).alias("window"), start.alias("window_start"),
                       end.alias("window_end"), *keys, F.col("_n").alias(out))


def stream_window_count(df: DataFrame, ts: str, keys: list[str], size, slide=None, delay="0 seconds",
                        out: str = "n", method: str = "auto") -> DataFrame:
    """Append-mode counts per window and key.

    Columns: ``window`` (start, end), ``window_start``, ``window_end``, keys,
    ``out``, whatever the method; in the ``native`` and ``explode`` forms ``window``
    is an event-time column, so another aggregation can chain on it.
    ``delay=None``: the input already carries a watermark (e.g. a stateful
    operator's output); the ``explode`` form needs a delay.

    ``method``: ``native`` (``window(ts, size, slide)``), ``explode`` (each
    event to its window starts, then one aggregation), ``panes`` (Spark counts
    each event once into its pane; a per-key ``transformWithState`` turns the
    closed panes into windows, so Python sees pane totals, never events).
    ``auto`` takes ``native`` up to 60 windows per event and ``panes`` above.
    """
    size_us = duration_us(size)
    slide_us = size_us if slide is None else duration_us(slide)
    k, rem = divmod(size_us, slide_us)
    if method == "auto":
        method = "native" if (rem or k <= STREAM_NATIVE_MAX_OVERLAP) else "panes"
    if method == "panes":
        if rem:
            raise ValueError("panes need size to be a multiple of slide")
        return _stream_panes(df, ts, keys, size_us, slide_us, k, delay, out)
    if method == "native" or rem:
        w = (F.window(ts, interval_literal(size)) if slide is None
             else F.window(ts, interval_literal(size), interval_literal(slide)))
        return (with_delay(df, ts, delay)
                  .groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias(out))
                  .select("window", F.col("window.start").alias("window_start"),
                          F.col("window.end").alias("window_end"), *keys, out))
    last = F.floor(to_us(ts) / F.lit(slide_us)).cast("long")
    starts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda j: F.timestamp_micros((last - j) * F.lit(slide_us)))
    fanned = df.select(F.explode(starts).alias("_ws"), *keys)
    # a start lags its newest event by up to size; events lag by up to delay
    lag = interval_literal(timedelta(microseconds=size_us + duration_us(delay)))
    # starts are slide-aligned, so a tumbling window of one slide holds exactly one start
    return (fanned.withWatermark("_ws", lag)
                  .groupBy(F.window("_ws", interval_literal(slide)).alias("window"), *keys)
                  .agg(F.count(F.lit(1)).alias(out))
                  .select("window", F.col("window.start").alias("window_start"),
                          (F.col("window.start") + F.expr(f"INTERVAL {size_us} MICROSECONDS"))
                          .alias("window_end"), *keys, out))


class _Ranked:
    """Heap entry ordered so that the *worse* entry is smaller: lower count,
    then larger key (keys rank ascending, nulls first, as in the batch form)."""

    __slots__ = ("n", "key", "row")

    def __init__(self, n, key, row):
        self.n, self.key, self.row = n, tuple((v is not None, v) for v in key), row

    def __lt__(self, other):
        return self.n < other.n or (self.n == other.n and self.key > other.key)


class TopNProcessor(StatefulProcessor):
    """Top N rows per grouping key with an N-entry heap; no state between batches.

    Chained after an append-mode window aggregation, every key of a closed
    window arrives in the same micro-batch, exactly once, so the rows of one
    call are the whole window. Memory is O(N) however many keys it has.
    """

    def __init__(self, n: int, group_cols, key_cols, order_col: str, rank_col: str | None):
        self.n, self.group_cols, self.key_cols = n, list(group_cols), list(key_cols)
        self.order_col, self.rank_col = order_col, rank_col

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        heap = []
        for r in rows:
            e = _Ranked(r[self.order_col], [r[k] for k in self.key_cols], r)
            if len(heap) < self.n:
                heapq.heappush(heap, e)
            elif heap[0] < e:
                heapq.heapreplace(heap, e)
        best = sorted(heap, reverse=True)
        for i, e in enumerate(best):
            out = {c: e.row[c] for c in self.group_cols}
            out.update({k: e.row[k] for k in self.key_cols})
            out[self.order_col] = e.n
            if self.rank_col:
                out[self.rank_col] = i + 1
            yield Row(**out)

    def close(self) -> None:
        pass


def stream_topn(counts: DataFrame, n: int, key_cols: list[str], order_col: str = "n",
                rank_col: str = "rank", method: str = "heap", salt_buckets: int = 1) -> DataFrame:
    """Top N per window on a stream of append-mode window counts.

    ``method='heap'`` (default): a stateless ``transformWithState`` per window
    keeps an N-entry heap while the window's rows stream through, so memory
    is O(N). With ``salt_buckets > 1`` a window's keys are first cut to their
    top N per hash bucket of the key (in parallel), then merged per window.
    ``method='collect'``: ``collect_list`` of (-count, key) structs sorted and
    sliced -- one group holds every key of a window.

    Ties: count descending, then key ascending (the batch rule).
    """
    if method == "collect":
        entry = F.struct((-F.col(order_col)).alias("_neg"), *[F.col(k) for k in key_cols])
        top = (counts.groupBy("window", "window_start", "window_end")
               .agg(F.slice(F.sort_array(F.collect_list(entry)), 1, n).alias("_top")))
        return (top.select("window_start", "window_end", F.posexplode("_top").alias("_pos", "_e"))
                   .select("window_start", "window_end", *[F.col(f"_e.{k}").alias(k) for k in key_cols],
                           (-F.col("_e._neg")).alias(order_col),
                           (F.col("_pos") + 1).cast("int").alias(rank_col)))
    win = ["window_start", "window_end"]
    fields = [counts.schema[c] for c in win + key_cols + [order_col]]
    src = counts.select(*win, *key_cols, order_col)
    if salt_buckets > 1:
        salted = src.withColumn("_salt", F.pmod(F.xxhash64(*key_cols), F.lit(salt_buckets)))
        part = T.StructType(fields)
        src = (salted.groupBy(*win, "_salt")
               .transformWithState(TopNProcessor(n, win, key_cols, order_col, None), part, "Append", "None"))
    schema = T.StructType(fields + [T.StructField(rank_col, T.IntegerType())])
    return (src.groupBy(*win)
            .transformWithState(TopNProcessor(n, win, key_cols, order_col, rank_col), schema, "Append", "None"))


def stream_sessions(df: DataFrame, key: str, ts: str, gap, delay="0 seconds") -> DataFrame:
    """Session windows in append mode: one state row for each open session; a session is given out when the
    watermark has passed its end."""
    w = F.session_window(ts, interval_literal(gap)).alias("_s")
    return (with_delay(df, ts, delay).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "n"))


def stream_pv(df: DataFrame, ts: str, size="1 hour", delay="0 seconds") -> DataFrame:
    return stream_window_count(df, ts, [], size, delay=delay, out="pv")


def stream_uv_exact(df: DataFrame, ts: str, user: str, size="1 hour", delay="0 seconds") -> DataFrame:
    """Exact UV: drop duplicate (window, user) with watermark-bounded state, then count."""
    w = with_delay(df, ts, delay).withColumn("window", F.window(ts, interval_literal(size)))
    return (w.dropDuplicates(["window", user]).groupBy("window").agg(F.count(F.lit(1)).alias("uv"))
             .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "uv"))


def stream_pv_uv(df: DataFrame, ts: str, user: str, size="1 hour", delay="0 seconds") -> DataFrame:
    """PV and exact UV: rows per (window, user), then per window. State: one row per user of an open window."""
    per_user = (with_delay(df, ts, delay).groupBy(F.window(ts, interval_literal(size)).alias("window"), user)
                .agg(F.count(F.lit(1)).alias("n")))
    return (per_user.groupBy("window").agg(F.sum("n").alias("pv"), F.count(user).alias("uv"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "pv", "uv"))


def stream_sliding_uv(df: DataFrame, ts: str, user: str, size, slide, delay="0 seconds") -> DataFrame:
    """Exact distinct users per sliding window: rows per (window, user), then per window.
    State: one row per user of an open window, so ``size / slide`` rows for an active user."""
    w = F.window(ts, interval_literal(size), interval_literal(slide)).alias("window")
    per_user = with_delay(df, ts, delay).groupBy(w, user).agg(F.count(F.lit(1)).alias("n")).where(F.col(user).isNotNull())
    return (per_user.groupBy("window").agg(F.count(F.lit(1)).alias("uv"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "uv"))


def stream_uv_bloom(df: DataFrame, ts: str, user: str, size="1 hour", delay="0 seconds", bits: int = BITS,
                    hashes: int = HASHES) -> DataFrame:
    """PV and UV by a Bloom filter: state is at most ``bits / 32768`` slices of 4 KB for each open window."""
    w = with_delay(df, ts, delay).withColumn("window", F.window(ts, interval_literal(size)))
    return (bloom_slices(w, "window", user, bits, hashes)
            .groupBy("window").agg(F.sum("_rows").alias("pv"), F.sum("_set").alias("_set"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "pv",
                    bloom_estimate(F.col("_set"), bits, hashes).alias("uv")))


def stream_pv_uv_approx(df: DataFrame, ts: str, user: str, size="1 hour", delay="0 seconds",
                        lg_k: int = 12) -> DataFrame:
    """PV and HLL-sketch UV in one aggregation; state per window is 2^lg_k registers."""
    return (with_delay(df, ts, delay)
              .groupBy(F.window(ts, interval_literal(size)).alias("window"))
              .agg(F.count(F.lit(1)).alias("pv"), F.hll_sketch_agg(user, lg_k).alias("_s"))
              .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      "pv", F.hll_sketch_estimate("_s").alias("uv")))

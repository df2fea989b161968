"""Per-key stateful stream operators on ``transformWithState`` (C1, C2, K1, K3, J1).

Each operator is a ``StatefulProcessor`` run by
``groupBy(keys).transformWithState(..., "Append", "EventTime")``; Spark keeps
the state in the RocksDB state store, checkpoints it with the query, and
restores it on restart or executor loss. Python runs only inside these
callbacks, on one key's rows at a time.

Ordering. Rows reach a key out of event-time order, across micro-batches.
C1, C2 and K1 depend on order, so their rows are first appended to a
list state and only handed to the operator logic, in (event time, tiebreak)
order, once the watermark has passed them: no row at or before the
watermark can arrive any more (Spark drops it as late). K3 does too, but keeps
only the earliest rows of a day that its limit can concern. J1 does not depend
on order: it matches rows as they come and keeps each only until no future row
can match it. State is read once and written once a drain, and a group has one timer.

Times inside the processors are epoch microseconds (``long``); the wrappers
convert to and from timestamps, so the Python worker's time zone never
matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import after_watermark, duration_us, from_us, to_us, with_delay
from .late import utc

DAY_US = 86_400_000_000


def _ceil_ms(us: int) -> int:
    return -((-us) // 1000)


def _key_fields(key, names):
    return dict(zip(names, key))


def _values(state) -> list:
    """A state row as a list; its arrays of rows as lists of tuples."""
    return [[tuple(x) for x in v] if isinstance(v, list) else v for v in state]


class _Buffered(StatefulProcessor):
    """Buffer rows until the watermark passes them; then process them in order.

    Subclasses set ``rec_schema`` (DDL; the first field is the event time in
    microseconds, the following ones complete the sort order) and ``state_schema``
    (DDL of what they remember between events), and implement ``start`` (the state
    of a new key), ``on_event`` (one record, in order), optionally ``on_watermark``
    (after every drain) and ``wake`` (when the state needs a drain by itself, or
    None; a state that is None is forgotten). A drain reads buffer and state once,
    works on a Python list, and writes each back once; a key has one timer, at the
    oldest buffered row or where its state wakes.
    """

    rec_schema = "us long, tb long"
    state_schema = "x long"

    def __init__(self, key_names):
        self.key_names = list(key_names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buf = handle.getListState("buf", self.rec_schema)
        self.state = handle.getValueState("state", self.state_schema)
        self.drain_at = handle.getValueState("drain_at", "ms long")
        self.drained = handle.getValueState("drained", "us long")  # watermark of the last drain

    def record(self, row) -> tuple:
        raise NotImplementedError

    def start(self) -> list:
        raise NotImplementedError

    def on_event(self, key, rec, st: list, out: list) -> None:
        raise NotImplementedError

    def on_watermark(self, key, wm_us: int, st: list, out: list) -> None:
        pass

    def wake(self, st: list, wm_us: int) -> int | None:
        return None

    def order(self, rec: tuple):
        return rec

    def _arm(self, us: int) -> None:
        ms = _ceil_ms(us)
        cur = self.drain_at.get() if self.drain_at.exists() else None
        if cur is None or ms < cur[0]:
            self.handle.registerTimer(ms)
            self.drain_at.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        # Rows behind this batch's watermark still precede its drain, so they can be put in order.
        # Only rows behind the last drain cannot; Spark filters (and counts) those before they get here.
        drained = self.drained.get()[0] if self.drained.exists() else None
        recs = [rec for rec in (self.record(r) for r in rows) if drained is None or rec[0] >= drained]
        if recs:
            for rec in recs:
                self.buf.appendValue(rec)
            self._arm(min(r[0] for r in recs))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        items = [tuple(x) for x in self.buf.get()] if self.buf.exists() else []
        ready = sorted((x for x in items if x[0] <= wm_us), key=self.order)
        rest = [x for x in items if x[0] > wm_us]
        had = self.state.exists()
        st, out = (_values(self.state.get()) if had else self.start()), []
        before = _values(st) if had else None
        for rec in ready:
            self.on_event(key, rec, st, out)
        self.on_watermark(key, wm_us, st, out)
        wake = self.wake(st, wm_us)
        if ready:
            self.drained.update((wm_us,))
            self.buf.clear()
            if rest:
                self.buf.put(rest)
        if st[0] is None:
            if had:
                self.state.clear()
        elif st != before:
            self.state.update(tuple(st))
        self.drain_at.clear()
        times = [x[0] for x in rest] + ([wake] if wake is not None else [])
        if times:
            self._arm(min(times))
        return iter(out)

    def close(self) -> None:
        pass


# C1 ------------------------------------------------------------------------
class ConsecutiveProcessor(_Buffered):
    """``times`` adjacent events of a key all hit and span at most ``within``."""

    rec_schema = "us long, tb long, hit boolean"
    state_schema = "tail array<struct<us:bigint,tb:bigint,hit:boolean>>"

    def __init__(self, key_names, times: int, within_us: int):
        super().__init__(key_names)
        self.times, self.within = times, within_us

    def record(self, r):
        return (r["_us"], r["_tb"], bool(r["_hit"]))

    def start(self):
        return [None]

    def on_event(self, key, rec, st, out):
        win = ((st[0] or []) + [rec])[-self.times:]
        if (len(win) == self.times and all(x[2] for x in win)
                and win[-1][0] - win[0][0] <= self.within):
            out.append(Row(**_key_fields(key, self.key_names), first_us=win[0][0], last_us=win[-1][0],
                           first_tb=win[0][1], last_tb=win[-1][1]))
        st[0] = win[-(self.times - 1):] if self.times > 1 else None

    def on_watermark(self, key, wm_us, st, out):
        # once the newest kept event is older than `within`, or a row that does not hit ends the run, no match can use it
        if st[0] and (st[0][-1][0] + self.within < wm_us or not st[0][-1][2]):
            st[0] = None

    def wake(self, st, wm_us):
        return st[0][-1][0] + self.within + 1000 if st[0] else None


def stream_consecutive(df: DataFrame, key, ts: str, pred, times: int = 2, within="2 seconds",
                       tiebreak: str | None = None, delay="0 seconds") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    within_us = duration_us(within)
    src = with_delay(df, ts, delay).select(
                    *keys, F.col(ts).alias("_t"), to_us(ts).alias("_us"),
                    (F.col(tiebreak).cast("long") if tiebreak else F.lit(0).cast("long")).alias("_tb"),
                    F.coalesce(pred, F.lit(False)).alias("_hit"))
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()),
        T.StructField("first_tb", T.LongType()), T.StructField("last_tb", T.LongType())])
    out = (src.groupBy(*keys)
           .transformWithState(ConsecutiveProcessor(keys, times, within_us), schema, "Append", "EventTime"))
    return out.select(*keys, from_us("first_us").alias("first_ts"), from_us("last_us").alias("last_ts"),
                      *([F.col("first_tb").alias(f"first_{tiebreak}"), F.col("last_tb").alias(f"last_{tiebreak}")]
                        if tiebreak else []))


# C2 ------------------------------------------------------------------------
class FollowedByProcessor(_Buffered):
    """first -> earliest second within ``within``; else timeout at first + within."""

    rec_schema = "us long, kind int, tb long"
    state_schema = "pending array<struct<us:bigint,tb:bigint>>, last_first bigint"

    def __init__(self, key_names, within_us: int, forget_us: int | None = None):
        super().__init__(key_names)
        self.within, self.forget = within_us, forget_us

    def record(self, r):
        return (r["_us"], r["_k"], r["_tb"])

    def start(self):
        return [None, None]

    def _row(self, key, kind, f_us, s_us, f_tb, s_tb):
        return Row(**_key_fields(key, self.key_names), kind=kind, first_us=f_us, second_us=s_us,
                   first_tb=f_tb, second_tb=s_tb)

    def on_event(self, key, rec, st, out):
        us, kind, tb = rec
        if kind == 0:
            if st[0] is None:
                st[0] = []
            st[0].append((us, tb))
            st[1] = us
            return
        for f_us, f_tb in st[0] or ():
            if us - f_us <= self.within:
                out.append(self._row(key, "matched", f_us, us, f_tb, tb))
            else:
                out.append(self._row(key, "timeout", f_us, None, f_tb, None))
        st[0] = []
        if st[1] is None or (self.forget is not None and us - st[1] > self.forget):
            out.append(self._row(key, "unmatched_second", None, us, None, tb))

    def on_watermark(self, key, wm_us, st, out):
        due = [p for p in st[0] or () if p[0] + self.within <= wm_us]
        if due:
            st[0] = [p for p in st[0] if p[0] + self.within > wm_us]
            out.extend(self._row(key, "timeout", f_us, None, f_tb, None) for f_us, f_tb in due)
        if st[1] is None or (not st[0] and self.forget is not None and st[1] + self.forget < wm_us):
            st[0] = None  # nothing to remember
        else:
            st[0] = st[0] or []

    def wake(self, st, wm_us):
        if st[0]:
            return st[0][0][0] + self.within
        return st[1] + self.forget + 1000 if st[0] is not None and self.forget is not None else None


def stream_followed_by(df: DataFrame, key, ts: str, is_first, is_second, within="15 minutes",
                       tiebreak: str | None = None, delay="0 seconds", forget=None) -> DataFrame:
    """``forget``: a second counts as unmatched if the last first lies longer back than that, and the key's
    state goes then. ``None``, the batch rule: any earlier first counts, and one time a key is kept for ever."""
    keys = [key] if isinstance(key, str) else list(key)
    src = (with_delay(df, ts, delay).where(after_watermark(is_first | is_second, ts))
             .select(*keys, F.col(ts).alias("_t"), to_us(ts).alias("_us"),
                     F.when(is_first, F.lit(0)).otherwise(F.lit(1)).alias("_k"),
                     (F.col(tiebreak).cast("long") if tiebreak else F.lit(0).cast("long")).alias("_tb")))
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("kind", T.StringType()), T.StructField("first_us", T.LongType()),
        T.StructField("second_us", T.LongType()), T.StructField("first_tb", T.LongType()),
        T.StructField("second_tb", T.LongType())])
    out = (src.groupBy(*keys)
           .transformWithState(FollowedByProcessor(keys, duration_us(within), None if forget is None else duration_us(forget)),
                               schema, "Append", "EventTime"))
    return out.select(*keys, "kind", from_us("first_us").alias("first_ts"),
                      from_us("second_us").alias("second_ts"),
                      *([F.col("first_tb").alias(f"first_{tiebreak}"),
                         F.col("second_tb").alias(f"second_{tiebreak}")] if tiebreak else []))


# K1 ------------------------------------------------------------------------
class RisingProcessor(_Buffered):
    """Alarm when a run of strict rises started ``duration`` ago and has not broken.

    ``alarm='evidence'`` (default, same as the batch form): the alarm needs a
    rising sample at or after ``run_start + duration``. ``alarm='timer'`` (the
    KeyedProcessFunction + timer form): the alarm also fires when the
    watermark passes the deadline with no break seen before it, even if no
    sample of the key arrived after the deadline.
    """

    rec_schema = "us long, tb long, v double"
    state_schema = "seen boolean, prev double, start bigint, alarmed boolean"

    def __init__(self, key_names, duration_us: int, alarm: str = "evidence"):
        super().__init__(key_names)
        if alarm not in ("evidence", "timer"):
            raise ValueError("alarm must be 'evidence' or 'timer'")
        self.duration, self.timer = duration_us, alarm == "timer"

    def record(self, r):
        return (r["_us"], r["_tb"], r["_v"])

    def start(self):
        return [None, None, None, False]

    def _due(self, key, now_us, st, out):
        if st[2] is not None and not st[3] and st[2] + self.duration <= now_us:
            st[3] = True
            out.append(Row(**_key_fields(key, self.key_names), run_start_us=st[2], alarm_us=st[2] + self.duration))

    def on_event(self, key, rec, st, out):
        us, _, v = rec
        if self.timer:
            self._due(key, us, st, out)  # the deadline passed before this sample
        prev = st[1]  # null value: no rise, and a break
        if prev is not None and v is not None and v > prev:
            if st[2] is None:
                st[2], st[3] = us, False
            elif not self.timer:
                self._due(key, us, st, out)  # a rising sample at or after the deadline
        else:
            st[2], st[3] = None, False
        st[0], st[1] = True, v

    def on_watermark(self, key, wm_us, st, out):
        if self.timer:
            self._due(key, wm_us, st, out)

    def wake(self, st, wm_us):
        return st[2] + self.duration if self.timer and st[2] is not None and not st[3] else None


def stream_rising(df: DataFrame, key, ts: str, value: str, duration="10 seconds",
                  tiebreak: str | None = None, delay="0 seconds", alarm: str = "evidence") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    src = with_delay(df, ts, delay).select(
                    *keys, F.col(ts).alias("_t"), to_us(ts).alias("_us"),
                    (F.col(tiebreak).cast("long") if tiebreak else F.lit(0).cast("long")).alias("_tb"),
                    F.col(value).cast("double").alias("_v"))
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("run_start_us", T.LongType()), T.StructField("alarm_us", T.LongType())])
    out = (src.groupBy(*keys)
           .transformWithState(RisingProcessor(keys, duration_us(duration), alarm), schema, "Append", "EventTime"))
    return out.select(*keys, from_us("run_start_us").alias("run_start"), from_us("alarm_us").alias("alarm_ts"))


# J3 ------------------------------------------------------------------------
class AsofProcessor(_Buffered):
    """Left rows get the key's latest right row at or before them; the state is that one row."""

    def __init__(self, key_names, left: list[tuple[str, str]], right: list[tuple[str, str]], tolerance_us: int | None):
        super().__init__(key_names)
        self.left, self.right, self.tolerance = list(left), list(right), tolerance_us
        values = ", ".join(f"{n} {kind}" for n, kind in [*left, *right])
        self.rec_schema = f"us long, side int, tb long, {values}"
        self.state_schema = ", ".join(["at bigint", *[f"{n} {kind}" for n, kind in right]])

    def record(self, r):
        return (r["_us"], r["_side"], r["_tb"], *[r[n] for n, _ in self.left], *[r[n] for n, _ in self.right])

    def start(self):
        return [None] * (1 + len(self.right))

    def order(self, rec):
        return rec[0], rec[1], rec[2] is not None, rec[2] or 0

    def on_event(self, key, rec, st, out):
        us, side, mine, theirs = rec[0], rec[1], rec[3:3 + len(self.left)], rec[3 + len(self.left):]
        if side == 0:
            if key[0] is not None:
                st[:] = [us, *theirs]
            return
        near = st[0] is not None and (self.tolerance is None or us - st[0] <= self.tolerance)
        out.append(Row(**_key_fields(key, self.key_names), _us=us, **{n: v for (n, _), v in zip(self.left, mine)},
                       _rus=st[0] if near else None, **{n: v if near else None for (n, _), v in zip(self.right, st[1:])}))

    def on_watermark(self, key, wm_us, st, out):
        if st[0] is not None and self.tolerance is not None and st[0] + self.tolerance < wm_us:
            st[:] = self.start()

    def wake(self, st, wm_us):
        return st[0] + self.tolerance + 1000 if st[0] is not None and self.tolerance is not None else None


def stream_asof(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, tolerance=None, tiebreak: str | None = None,
                delay="0 seconds") -> DataFrame:
    """``operators.asof.asof_join`` on streams: a left row is given out once the watermark has passed it.

    State per key: rows ahead of the watermark and one right row, which goes when it is
    older than ``tolerance`` (without one it stays). Left rows with a null time are dropped as late.
    """
    names = {"l": [c for c in left.columns if c not in (key, left_ts)], "r": [c for c in right.columns if c not in (key, right_ts)]}
    clash = ({left_ts, *names["l"]} & {right_ts, *names["r"]})
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    left, right = with_delay(left, left_ts, delay), with_delay(right, right_ts, delay)
    frames, schemas = {"l": left, "r": right}, {}
    # times travel as microseconds: their value does not depend on a worker's time zone
    is_time = lambda side, c: isinstance(frames[side].schema[c].dataType, (T.TimestampType, T.TimestampNTZType))
    plain = {side: [(to_us(c) if is_time(side, c) else F.col(f"`{c}`")).alias(f"{side}{i}") for i, c in enumerate(names[side])] for side in "lr"}
    for side in "lr":
        schemas[side] = [(f.name, f.dataType) for f in frames[side].select(*plain[side]).schema] if plain[side] else []

    def tagged(side, ts, number, tb):
        other = "r" if side == "l" else "l"
        cols = plain[side], [F.lit(None).cast(t).alias(n) for n, t in schemas[other]]
        return frames[side].select(F.col(key).alias("_key"), F.col(ts).alias("_t"), to_us(ts).alias("_us"), F.lit(number).alias("_side"),
                                   tb.cast("long").alias("_tb"), *cols[0], *cols[1])

    both = tagged("r", right_ts, 0, F.col(tiebreak) if tiebreak else F.lit(0)).unionByName(tagged("l", left_ts, 1, F.lit(0)))
    kinds = {side: [(n, t.simpleString()) for n, t in schemas[side]] for side in "lr"}
    out = T.StructType([T.StructField("_key", left.schema[key].dataType), T.StructField("_us", T.LongType())]
                       + [T.StructField(n, t) for n, t in schemas["l"]] + [T.StructField("_rus", T.LongType())]
                       + [T.StructField(n, t) for n, t in schemas["r"]])
    us = None if tolerance is None else duration_us(tolerance)
    found = both.groupBy("_key").transformWithState(AsofProcessor(["_key"], kinds["l"], kinds["r"], us), out, "Append", "EventTime")
    back = {side: {c: (from_us(f"{side}{i}", frames[side].schema[c].dataType) if is_time(side, c) else F.col(f"{side}{i}"))
                   for i, c in enumerate(names[side])} for side in "lr"}
    of = {key: F.col("_key"), left_ts: from_us("_us"), right_ts: from_us("_rus")} | back["l"] | back["r"]
    return found.select(*[of[c].alias(c) for c in [*left.columns, *[c for c in right.columns if c != key]]])


# K3 ------------------------------------------------------------------------
def _earliest(rows: list, room: int) -> list:
    """The ``room`` earliest rows by (time, tiebreak), nulls first."""
    return sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[:max(room, 0)]


class CutProcessor(StatefulProcessor):
    """The ``room`` earliest rows of a micro-batch per key, day and slice; no state.

    Rows of a hot (key, day) are dealt out to slices first, so many tasks cut them;
    what a slice drops has ``room`` earlier rows and can never be among them.
    """

    def __init__(self, names: list[str], room: int):
        self.names, self.room = list(names), room

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        kept: list = []
        for r in rows:
            kept.append((r["_us"], r["_tb"], r))
            if len(kept) >= 2 * self.room + 1024:
                kept = _earliest(kept, self.room)
        for us, _, r in _earliest(kept, self.room):
            yield Row(**{c: r[c] for c in self.names}, _t=utc(us))

    def close(self) -> None:
        pass


class BlacklistProcessor(StatefulProcessor):
    """Pass the first ``limit`` rows of a key per UTC day, alert on row ``limit + 1``.

    State per day: how many rows have been released, and of those still ahead of the
    watermark the earliest that can matter: released and pending are ``limit + 1`` at
    most, however many rows the day has. Rows are released in order as the watermark
    passes them; a day is forgotten when it ends. A drain reads and writes a day once.
    """

    def __init__(self, key_names, limit: int, others: list[tuple[str, str]]):
        self.key_names, self.limit, self.others = list(key_names), limit, list(others)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        more = "".join(f",c{i}:{kind}" for i, (_, kind) in enumerate(self.others))
        self.days = handle.getMapState("days", "day long", f"released int, rows array<struct<us:bigint,tb:bigint{more}>>")
        self.drain_at = handle.getValueState("drain_at", "ms long")
        self.drained = handle.getValueState("drained", "us long")

    def _arm(self, us: int) -> None:
        ms = _ceil_ms(us)
        if not self.drain_at.exists() or ms < self.drain_at.get()[0]:
            self.handle.registerTimer(ms)
            self.drain_at.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        drained = self.drained.get()[0] if self.drained.exists() else None
        new: dict[int, list] = {}
        for r in rows:
            us = r["_us"]
            if drained is None or us >= drained:
                mine = new.setdefault(us // DAY_US, [])
                mine.append((us, r["_tb"], *[r[c] for c, _ in self.others]))
                if len(mine) >= 2 * self.limit + 1024:
                    new[us // DAY_US] = _earliest(mine, self.limit + 1)
        for day, mine in new.items():
            released, pending = _values(self.days.getValue((day,))) if self.days.containsKey((day,)) else (0, [])
            kept = _earliest(pending + mine, self.limit + 1 - released)
            if kept != pending or not released:
                self.days.updateValue((day,), (released, kept))
                self._arm(min([(day + 1) * DAY_US, *[x[0] for x in kept[:1]]]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        out, wake = [], []
        for (day,), state in sorted((tuple(k), _values(v)) for k, v in self.days.iterator()):
            released, pending = state
            ready = [x for x in pending if x[0] <= wm_us]
            for us, tb, *others in ready:
                released += 1
                out.append(Row(**_key_fields(key, self.key_names), day=day, us=us, tb=tb, **{c: v for (c, _), v in zip(self.others, others)},
                               kind="kept" if released <= self.limit else "alert", _t=utc(us)))
            if (day + 1) * DAY_US <= wm_us:
                self.days.removeKey((day,))
                continue
            if ready:
                self.days.updateValue((day,), (released, pending[len(ready):]))
            wake += [(day + 1) * DAY_US, *[x[0] for x in pending[len(ready):len(ready) + 1]]]
        self.drained.update((wm_us,))
        self.drain_at.clear()
        if wake:
            self._arm(min(wake))
        return iter(out)

    def close(self) -> None:
        pass


def stream_blacklist(df: DataFrame, keys: list[str], ts: str, limit: int = 100, tiebreak: str | None = None,
                     delay="0 seconds", keep: list[str] | None = None, salt_buckets: int = 1) -> DataFrame:
    """Rows tagged ``kind`` = 'kept' (the first ``limit`` per key and day) or 'alert'.

    Columns: keys, day, ``ts``, the tiebreak, the columns of ``keep``, kind. ``ts`` is the
    output's event-time column (watermarked), so a windowed aggregation can follow directly
    (``stream_window_count(..., delay=None)``). With ``salt_buckets > 1`` each micro-batch is
    cut to its ``limit + 1`` earliest rows per key, day and slice first, for keys that hold a
    large share of the rows. Without a tiebreak, rows of a key at the same time are equal:
    which of them is kept does not show but in ``keep``.
    """
    keys, keep = list(keys), [c for c in keep or [] if c not in (ts, tiebreak, *keys)]
    names = [f"_c{i}" for i in range(len(keep))]
    src = with_delay(df, ts, delay)
    # times travel as microseconds: their value does not depend on a worker's time zone
    times = {c for c in keep if isinstance(src.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))}
    src = src.select(*keys, F.col(ts).alias("_t"), to_us(ts).alias("_us"),
                     (F.col(tiebreak).cast("long") if tiebreak else F.lit(0).cast("long")).alias("_tb"),
                     *[(to_us(c) if c in times else F.col(c)).alias(n) for c, n in zip(keep, names)])
    if salt_buckets > 1:
        every = [c for c in src.columns if c != "_t"]
        salted = src.withColumn("_day", F.floor(F.col("_us") / F.lit(DAY_US))).withColumn(
            "_salt", F.pmod(F.xxhash64("_us", "_tb", *names), F.lit(salt_buckets)))
        cut = T.StructType([src.schema[c] for c in every] + [T.StructField("_t", T.TimestampType())])
        src = salted.groupBy(*keys, "_day", "_salt").transformWithState(
            CutProcessor(every, limit + 1), cut, "Append", "EventTime", eventTimeColumnName="_t")
    kinds = [(n, src.schema[n].dataType.simpleString()) for n in names]
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("day", T.LongType()), T.StructField("us", T.LongType()), T.StructField("tb", T.LongType()),
        *[T.StructField(n, src.schema[n].dataType) for n in names], T.StructField("kind", T.StringType()),
        T.StructField("_t", T.TimestampType())])
    out = (src.groupBy(*keys)
           .transformWithState(BlacklistProcessor(keys, limit, kinds), schema, "Append", "EventTime",
                               eventTimeColumnName="_t"))
    back = [(from_us(n, df.schema[c].dataType) if c in times else F.col(n)).alias(c) for c, n in zip(keep, names)]
    return out.select(*keys, F.date_from_unix_date(F.col("day").cast("int")).alias("day"), F.col("_t").alias(ts),
                      *([F.col("tb").alias(tiebreak)] if tiebreak else []), *back, "kind")


# J1 ------------------------------------------------------------------------
class ReconcileProcessor(StatefulProcessor):
    """Pairs and lonely rows of one key in one stretch of time.

    Times count half microseconds, pays shifted by ``lower + upper``, so that partners
    lie at most ``half = upper - lower`` apart on either side. A row is at home in one stretch and visits a neighbour that its range reaches into.
    Pairs are reported where the pay is at home, as soon as both rows are in; a row
    is lonely if no partner, at home or visiting, came to its home.

    State: rows by slot, a fraction of the range long. A new row reads the slots in
    its range, so its cost is that of its matches and does not grow with the rows
    that the key has waiting. Whole slots are reported and dropped when the watermark
    proves that no partner can come; one timer a group, at the next such time.
    """

    def __init__(self, key_names, half: int, shift: int, slot: int):
        self.key_names, self.half, self.shift, self.slot = list(key_names), half, shift, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = "rows array<struct<us:bigint,id:bigint,home:boolean,matched:boolean>>"
        self.sides = [handle.getMapState("pays", "slot long", rows), handle.getMapState("receipts", "slot long", rows)]
        self.drain_at = handle.getValueState("drain_at", "ms long")

    def _row(self, key, kind, p, r):
        return Row(**_key_fields(key[:1], self.key_names), kind=kind,
                   pay_us=(p[0] - self.shift) // 2 if p else None, pay_id=p[1] if p else None,
                   receipt_us=r[0] // 2 if r else None, receipt_id=r[1] if r else None)

    def _final(self, side: int, slot: int) -> int:
        """Watermark (half microseconds) at which no partner of a row in the slot can come: a receipt up to pay + upper,
        a pay up to receipt - lower."""
        return (slot + 1) * self.slot + self.half - (self.shift if side else 0)

    def _arm(self, halves: int) -> None:
        ms = _ceil_ms(-(-halves // 2))
        if not self.drain_at.exists() or ms < self.drain_at.get()[0]:
            self.handle.registerTimer(ms)
            self.drain_at.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        known: tuple[dict, dict] = ({}, {})
        dirty = set()

        def of(side: int, slot: int) -> list:
            if slot not in known[side]:
                has = self.sides[side].containsKey((slot,))
                known[side][slot] = [list(x) for x in self.sides[side].getValue((slot,))[0]] if has else []
            return known[side][slot]

        nokey = key[0] is None  # a null key never matches
        for r in rows:
            side, us = r["_side"], r["_us"]
            me = [us, r["_id"], r["_home"], False]
            if not nokey:
                for slot in range((us - self.half) // self.slot, (us + self.half) // self.slot + 1):
                    for other in of(1 - side, slot):
                        if abs(other[0] - us) <= self.half and (me[2] or other[2]):
                            pay, receipt = (me, other) if side == 0 else (other, me)
                            if pay[2]:
                                yield self._row(key, "matched", pay, receipt)
                            me[3] = True
                            if not other[3]:
                                other[3] = True
                                dirty.add((1 - side, slot))
            of(side, us // self.slot).append(me)
            dirty.add((side, us // self.slot))
        for side, slot in dirty:
            self.sides[side].updateValue((slot,), ([tuple(x) for x in known[side][slot]],))
        if dirty:
            self._arm(min(self._final(side, slot) for side, slot in dirty))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 2000
        left = []
        for side, state in enumerate(self.sides):
            for (slot,) in [tuple(k) for k in state.keys()]:
                if self._final(side, slot) > now:
                    left.append(self._final(side, slot))
                    continue
                for row in state.getValue((slot,))[0]:
                    if row[2] and not row[3]:
                        yield self._row(key, "receipt_only", None, row) if side else self._row(key, "pay_only", row, None)
                state.removeKey((slot,))
        self.drain_at.clear()
        if left:
            self._arm(min(left))

    def close(self) -> None:
        pass


def stream_reconcile(pays: DataFrame, receipts: DataFrame, key: str, pay_ts: str, receipt_ts: str,
                     lower, upper, pay_id: str, receipt_id: str, delay="0 seconds", stretch=None) -> DataFrame:
    """The connect + CoProcessFunction job: both streams tagged and unioned. The watermark is set
    on each stream (``delay=None``: both carry one); the slower one counts.

    Rows are keyed by (key, stretch of time), so a hot key is divided over time.
    ``stretch`` (twice the width of the range by default) says how long; a row is
    copied once if its range reaches into a neighbour."""
    lo, hi = duration_us(lower), duration_us(upper)
    if lo > hi:
        raise ValueError("lower must not exceed upper")
    long = 2 * (max(2 * (hi - lo), 600_000_000) if stretch is None else duration_us(stretch))
    pays, receipts = with_delay(pays, pay_ts, delay), with_delay(receipts, receipt_ts, delay)

    def side(df, ts, row_id, number, shift):
        return df.select(F.col(key).alias("_key"), F.col(ts).alias("_t"), F.col(row_id).cast("long").alias("_id"),
                         F.lit(number).alias("_side"), (to_us(ts) * 2 + F.lit(shift)).cast("long").alias("_us"))

    tagged = side(pays, pay_ts, pay_id, 0, lo + hi).unionByName(side(receipts, receipt_ts, receipt_id, 1, 0))
    stretch_of = lambda u: F.floor(u / F.lit(long)).cast("long")
    u = F.col("_us")
    tagged = tagged.withColumn("_stretch", F.explode(F.sequence(stretch_of(u - F.lit(hi - lo)), stretch_of(u + F.lit(hi - lo)))))
    tagged = tagged.withColumn("_home", F.col("_stretch") == stretch_of(u))
    ktype = pays.schema[key].dataType
    schema = T.StructType([T.StructField("_key", ktype), T.StructField("kind", T.StringType()),
                           T.StructField("pay_us", T.LongType()), T.StructField("pay_id", T.LongType()),
                           T.StructField("receipt_us", T.LongType()), T.StructField("receipt_id", T.LongType())])
    processor = ReconcileProcessor(["_key"], hi - lo, lo + hi, max((hi - lo) // 4, long // 64, 1))
    out = tagged.groupBy("_key", "_stretch").transformWithState(processor, schema, "Append", "EventTime")
    return out.select(F.col("_key").alias(key), "kind", from_us("pay_us").alias(pay_ts),
                      F.col("pay_id").alias(pay_id), from_us("receipt_us").alias(receipt_ts),
                      F.col("receipt_id").alias(receipt_id))

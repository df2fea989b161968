"""Late rows (W6): every row of a stream once, marked ``ontime`` or ``late``, and complete counts of dropped rows.

Spark drops a row at or before the watermark inside a stateful operator, with a
count but without the row. ``mark_late`` looks at the watermark itself, before
any such operator, and lets both kinds through, so that late rows can be written
to an output of their own (``write_split``) and none is lost: rows marked
``ontime`` plus rows marked ``late`` are the input, also across restarts.

``LateRowCounter`` adds up the rows that Spark's operators drop, over every
progress report of a query, not only the last ones that Spark retains.
"""

from __future__ import annotations

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.time import from_us, to_us, with_delay

SLICES = 64


def utc(us: int) -> datetime:
    """A zone-aware time, so event-time columns do not depend on the worker's zone."""
    return datetime.fromtimestamp(us // 1_000_000, tz=timezone.utc).replace(microsecond=us % 1_000_000)


class LateProcessor(StatefulProcessor):
    """Mark rows by the watermark of their batch; the state is two counters a slice."""

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", "ontime long, late long")

    def handleInputRows(self, key, rows, timerValues):
        wm = timerValues.getCurrentWatermarkInMs() * 1000
        n = [0, 0]
        for r in rows:
            us = r["_us"]
            late = us is None or us <= wm
            n[late] += 1
            yield Row(_row=r["_row"], _us=us, kind="late" if late else "ontime", event_time=utc(wm + 1000 if late else us))
        ontime, late = self.totals.get() if self.totals.exists() else (0, 0)
        self.totals.update((ontime + n[0], late + n[1]))

    def close(self) -> None:
        pass


def mark_late(df: DataFrame, ts: str, delay="0 seconds", slices: int = SLICES, kind: str = "kind") -> DataFrame:
    """``df`` plus ``kind`` (``ontime`` or ``late``) and ``event_time``, the event time of what follows.

    A row is late if its time is null or at or before the watermark when its batch
    starts; Spark's own operators wait one batch longer, so none drops an ``ontime``
    row. ``event_time`` is ``ts`` for such rows, and the watermark for late ones (an
    operator may not emit what is behind it): use windows on ``event_time`` of the
    ``ontime`` rows. Rows are dealt out by their hash, so no key can become hot.
    ``delay=None``: the input carries a watermark on ``ts``.
    """
    taken = {c.lower() for c in df.columns}
    if kind.lower() in taken or "event_time" in taken - {ts.lower()}:
        raise ValueError(f"the columns {kind} and event_time are taken")
    marked = with_delay(df, ts, delay)
    others = [c for c in marked.columns if c != ts]
    # event time itself is not passed on as a column, else late rows would be dropped here as well
    rows = marked.select(F.pmod(F.xxhash64(*[F.col(c) for c in marked.columns]), F.lit(slices)).alias("_slice"),
                         F.struct(*others).alias("_row") if others else F.struct(F.lit(0).alias("_")).alias("_row"), to_us(ts).alias("_us"))
    schema = T.StructType([rows.schema["_row"], rows.schema["_us"], T.StructField("kind", T.StringType()),
                           T.StructField("event_time", T.TimestampType())])
    out = rows.groupBy("_slice").transformWithState(LateProcessor(), schema, "Append", "EventTime", eventTimeColumnName="event_time")
    back = {c: F.col(f"_row.`{c}`") for c in others} | ({} if ts.lower() == "event_time" else {ts: from_us("_us")})
    return out.select(*[back[c].alias(c) for c in marked.columns if c in back], F.col("kind").alias(kind), "event_time")


class LateRowCounter(StreamingQueryListener):
    """Rows dropped as late by the stateful operators of each query, over all its runs in this session."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._dropped: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}

    def attach(self, spark: SparkSession) -> LateRowCounter:
        spark.streams.addListener(self)
        return self

    def detach(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        with self._lock:
            self._dropped[str(event.progress.id)] = self._dropped.get(str(event.progress.id), 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.setdefault(str(event.runId), threading.Event()).set()

    def dropped(self, query, timeout: float = 30.0) -> int:
        """Total of a query's id. For an ended run, waits until its last report has come."""
        if not query.isActive:
            with self._lock:
                ended = self._ended.setdefault(str(query.runId), threading.Event())
            ended.wait(timeout)
        with self._lock:
            return self._dropped.get(str(query.id), 0)

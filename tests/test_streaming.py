"""Batch = stream: every stream form, fed in several out-of-order micro-batches, equals its batch form.

Input rows are written as several parquet files read one per micro-batch,
with a share of rows held back a batch, so rows arrive out of event-time
order (within the watermark delay). A sentinel row far in the future is
written last so the watermark passes every window and timer; results for
the sentinel's key are ignored.
"""

import os
import random
import tempfile
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import fixture_path
from streamwatch.operators.blacklist import click_blacklist
from streamwatch.operators.joins import interval_join, reconcile
from streamwatch.operators.patterns import consecutive, followed_by_within
from streamwatch.operators.rising import rising_alarm
from streamwatch.operators.topn import window_topn
from streamwatch.operators.windows import pv_uv, window_count
from streamwatch.sources.logs import read_log
from streamwatch.streaming.joins import stream_interval_join
from streamwatch.streaming.processors import (stream_blacklist, stream_consecutive, stream_followed_by,
                                              stream_reconcile, stream_rising)
from streamwatch.streaming.runner import run_available, stream_parquet
from streamwatch.streaming.windows import (stream_pv, stream_pv_uv_approx, stream_topn, stream_uv_exact,
                                           stream_window_count)

SENTINEL_SHIFT = timedelta(days=3)


def as_stream(spark, df, ts, chunks=4, seed=1, sentinel=None, late_frac=0.25):
    """Write ``df`` (in its arrival order) as ``chunks`` files, one per micro-batch.

    A random ``late_frac`` of the rows is held back to the next file, so rows
    arrive out of event-time order by up to one chunk's time span; callers set
    the watermark delay above that. A sentinel file far in the future comes last.
    """
    d = tempfile.mkdtemp(prefix="sw-stream-")
    rows = df.collect()
    rnd = random.Random(seed)
    size = max(1, -(-len(rows) // chunks))
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]
    held = []
    for i, part in enumerate(parts):
        late = [i < len(parts) - 1 and rnd.random() < late_frac for _ in part]
        now = held + [r for r, x in zip(part, late) if not x]
        held = [r for r, x in zip(part, late) if x]
        spark.createDataFrame(now, df.schema).coalesce(1).write.parquet(os.path.join(d, f"chunk{i:03d}"))
        time.sleep(0.05)
    if sentinel is not None:
        time.sleep(1.1)  # file sources order by modification time: the sentinel must come last
        spark.createDataFrame([sentinel], df.schema).coalesce(1).write.parquet(os.path.join(d, "zz_sentinel"))
    return stream_parquet(spark, d + "/*", df.schema, max_files_per_trigger=1)


def sentinel_of(df, ts, shift=SENTINEL_SHIFT, **values):
    """A row after every other by ``shift`` (must exceed the watermark delay)."""
    row = df.orderBy(F.col(ts).desc()).first().asDict()
    row[ts] = row[ts] + shift
    row.update(values)
    return tuple(row[c] for c in df.columns)


def rows_of(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def load(spark, kind):
    return read_log(spark, kind, fixture_path(kind))


def test_stream_consecutive_login(spark):
    login = load(spark, "login")
    pred = F.col("event_type") == "fail"
    s = as_stream(spark, login, "event_time", chunks=6, sentinel=sentinel_of(login, "event_time", user_id=-1))
    got = run_available(stream_consecutive(s, "user_id", "event_time", pred, 2, "2 seconds", delay="60 seconds"))
    want = consecutive(login, "user_id", "event_time", pred, 2, "2 seconds")
    assert rows_of(got.where("user_id <> -1")) == rows_of(want)
    assert len(rows_of(want)) == 2


def test_stream_followed_by_order(spark):
    o = load(spark, "order")
    first, second = F.col("event_type") == "create", F.col("event_type") == "pay"
    s = as_stream(spark, o, "event_time", chunks=5, sentinel=sentinel_of(o, "event_time", order_id=-1))
    got = run_available(stream_followed_by(s, "order_id", "event_time", first, second, "900 seconds",
                                           delay="20 minutes"))
    want = followed_by_within(o, "order_id", "event_time", first, second, "900 seconds")
    assert rows_of(got.where("order_id <> -1")) == rows_of(want)


@pytest.mark.parametrize("lo,hi,expect", [(-5, 5, (5, 35, 35)), (-1800, 1800, (38, 2, 2))])
def test_stream_reconcile(spark, lo, hi, expect):
    pays = load(spark, "order").where("event_type = 'pay'").select(
        "tx_id", F.col("order_id").alias("pay_id"), F.col("event_time").alias("pay_time"))
    rec = load(spark, "receipt").withColumn("receipt_id", F.monotonically_increasing_id()).select(
        "tx_id", "receipt_id", F.col("event_time").alias("rec_time"))
    rec = spark.createDataFrame(rec.collect(), rec.schema)  # pin the ids
    ps = as_stream(spark, pays, "pay_time", chunks=3, sentinel=sentinel_of(pays, "pay_time", tx_id="~p"))
    rs = as_stream(spark, rec, "rec_time", chunks=3, seed=2, sentinel=sentinel_of(rec, "rec_time", tx_id="~r"))
    got = run_available(stream_reconcile(ps, rs, "tx_id", "pay_time", "rec_time", lo, hi, "pay_id",
                                         "receipt_id", delay="1 hour")).where("tx_id NOT LIKE '~%'")
    want = reconcile(pays, rec, "tx_id", "pay_time", "rec_time", lo, hi)
    assert rows_of(got) == rows_of(want.select(*got.columns))
    counts = {k: got.where(F.col("kind") == k).count() for k in ("matched", "pay_only", "receipt_only")}
    assert (counts["matched"], counts["pay_only"], counts["receipt_only"]) == expect


def test_stream_blacklist_ad_click(spark):
    ad = load(spark, "ad_click")
    s = as_stream(spark, ad, "event_time", chunks=5, sentinel=sentinel_of(ad, "event_time", user_id=-1))
    got = run_available(stream_blacklist(s, ["user_id", "ad_id"], "event_time", 100, delay="2 hours")) \
        .where("user_id <> -1")
    kept, alerts = click_blacklist(ad, ["user_id", "ad_id"], "event_time", 100)
    assert got.where("kind = 'kept'").count() == kept.count() == 122
    a = got.where("kind = 'alert'").select("user_id", "ad_id", "day", F.col("event_time").alias("alert_ts"))
    assert rows_of(a) == rows_of(alerts)


def test_stream_rising_synthetic(spark):
    rows = [("s1", 1000 + 2 * i, float(v)) for i, v in
            enumerate([10, 11, 12, 13, 14, 15, 16, 15, 16, 17, 16, 17, 18, 19, 20])]
    rows += [("s2", 1000 + 2 * i, float(100 - i)) for i in range(8)]
    df = spark.createDataFrame(rows, "sensor_id string, t long, temperature double") \
        .withColumn("event_time", F.timestamp_seconds("t")).drop("t")
    s = as_stream(spark, df, "event_time", chunks=4, sentinel=sentinel_of(df, "event_time", sensor_id="zz"))
    got = run_available(stream_rising(s, "sensor_id", "event_time", "temperature", "10 seconds",
                                      delay="60 seconds")).where("sensor_id <> 'zz'")
    want = rising_alarm(df, "sensor_id", "event_time", "temperature", "10 seconds")
    assert rows_of(got) == rows_of(want) and len(rows_of(want)) == 1
    # timer form: the last run (1022..1028) never breaks, so its deadline 1032 also alarms
    s = as_stream(spark, df, "event_time", chunks=4, sentinel=sentinel_of(df, "event_time", sensor_id="zz"))
    timer = run_available(stream_rising(s, "sensor_id", "event_time", "temperature", "10 seconds",
                                        delay="60 seconds", alarm="timer")).where("sensor_id <> 'zz'")
    got_t = sorted((r.sensor_id, int(r.run_start.timestamp()), int(r.alarm_ts.timestamp()))
                   for r in timer.collect())
    assert got_t == [("s1", 1002, 1012), ("s1", 1022, 1032)]


@pytest.mark.parametrize("size,slide,method", [("1 hour", None, "auto"), ("1 hour", "5 seconds", "auto"),
                                               ("1 hour", "5 seconds", "explode"),
                                               ("10 minutes", "1 minute", "auto"),
                                               ("10 minutes", "1 minute", "panes")])
def test_stream_window_counts(spark, size, slide, method):
    ad = load(spark, "ad_click")
    s = as_stream(spark, ad, "event_time", chunks=4, sentinel=sentinel_of(ad, "event_time", province="~"))
    got = run_available(stream_window_count(s, "event_time", ["province"], size, slide, delay="2 hours",
                                            method=method)).drop("window").where("province <> '~'")
    want = window_count(ad, "event_time", ["province"], size, slide)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("method,salts", [("heap", 1), ("heap", 3), ("collect", 1)])
def test_stream_topn(spark, method, salts):
    ad = load(spark, "ad_click")
    s = as_stream(spark, ad, "event_time", chunks=4, sentinel=sentinel_of(ad, "event_time", province="~"))
    counts = stream_window_count(s, "event_time", ["province"], "10 minutes", "1 minute", delay="2 hours")
    got = run_available(stream_topn(counts, 2, ["province"], method=method, salt_buckets=salts)) \
        .where("province <> '~'")
    want = window_topn(window_count(ad, "event_time", ["province"], "10 minutes", "1 minute"), 2, ["province"])
    assert rows_of(got) == rows_of(want)


def test_stream_pv_uv(spark):
    ad = load(spark, "ad_click")
    sent = sentinel_of(ad, "event_time")
    s = as_stream(spark, ad, "event_time", chunks=4, sentinel=sent)
    want = {r.window_start: (r.pv, r.uv) for r in pv_uv(ad, "event_time", "user_id").collect()}
    pv = {r.window_start: r.pv for r in run_available(stream_pv(s, "event_time", delay="2 hours")).collect()}
    s = as_stream(spark, ad, "event_time", chunks=4, sentinel=sent)
    uv = {r.window_start: r.uv for r in run_available(stream_uv_exact(s, "event_time", "user_id",
                                                                       delay="2 hours")).collect()}
    s = as_stream(spark, ad, "event_time", chunks=4, sentinel=sent)
    approx = {r.window_start: (r.pv, r.uv) for r in
              run_available(stream_pv_uv_approx(s, "event_time", "user_id", delay="2 hours")).collect()}
    for w, (p, u) in want.items():
        assert pv[w] == p and uv[w] == u and approx[w] == (p, u)


def test_stream_interval_join(spark):
    pays = load(spark, "order").where("event_type = 'pay'").select(
        "tx_id", "order_id", F.col("event_time").alias("pay_time"))
    rec = load(spark, "receipt").select("tx_id", "pay_channel", F.col("event_time").alias("rec_time"))
    ps = as_stream(spark, pays, "pay_time", chunks=3)
    rs = as_stream(spark, rec, "rec_time", chunks=3, seed=3)
    got = run_available(stream_interval_join(ps, rs, "tx_id", "pay_time", "rec_time", -5, 5,
                                             "1 hour", "1 hour"))
    want = interval_join(pays, rec, "tx_id", "pay_time", "rec_time", -5, 5)
    assert rows_of(got) == rows_of(want.select(*got.columns)) and got.count() == 5


def test_stream_jobs_on_events_table(spark):
    """Repeated keys (many creates / pays per user) on the sf0.001 events table."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = spark.createDataFrame(ev.collect(), ev.schema)
    sent = sentinel_of(ev, "ts", shift=timedelta(days=90), user_id=-1, event_id=-1)
    first, second = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    s = as_stream(spark, ev, "ts", chunks=6, sentinel=sent)
    got = run_available(stream_followed_by(s, "user_id", "ts", first, second, "12 hours", "event_id",
                                           delay="30 days")).where("user_id <> -1")
    want = followed_by_within(ev, "user_id", "ts", first, second, "12 hours", "event_id")
    assert rows_of(got) == rows_of(want)
    s = as_stream(spark, ev, "ts", chunks=6, sentinel=sent)
    pred = F.col("event_type") == "error"
    got = run_available(stream_consecutive(s, "user_id", "ts", pred, 2, "1 hour", "event_id",
                                           delay="30 days")).where("user_id <> -1")
    assert rows_of(got) == rows_of(consecutive(ev, "user_id", "ts", pred, 2, "1 hour", "event_id"))


def test_stream_split_writes_main_and_side(spark):
    from streamwatch.streaming.joins import write_split
    login = load(spark, "login")
    s = as_stream(spark, login, "event_time", chunks=3)
    out = tempfile.mkdtemp(prefix="sw-split-")
    q = write_split(s, F.col("event_type") == "fail", os.path.join(out, "main"), os.path.join(out, "side"),
                    name=f"split-{random.randrange(10**9)}", trigger={"availableNow": True})
    q.awaitTermination()
    main = spark.read.parquet(os.path.join(out, "main"))
    side = spark.read.parquet(os.path.join(out, "side"))
    assert (main.count(), side.count()) == (9, 39)


def test_sql_over_streaming_view(spark):
    from streamwatch.operators.sql import register
    ad = load(spark, "ad_click")
    s = as_stream(spark, ad, "event_time", chunks=3, sentinel=sentinel_of(ad, "event_time", province="~"))
    register(s.withWatermark("event_time", "2 hours"), "sw_ad_stream")
    q = spark.sql("""SELECT window.start AS window_start, province, count(*) AS n FROM sw_ad_stream
                     GROUP BY window(event_time, '1 hour'), province""")
    got = run_available(q).where("province <> '~'")
    want = window_count(ad, "event_time", ["province"], "1 hour").drop("window_end")
    assert rows_of(got) == rows_of(want)


#: Stream jobs and the batch query with the same rows: (batch query, its columns or None for all).
SAME_ROWS = {
    "hot_items": ("hot_items", None), "hot_pages": ("hot_pages", None),
    "uv": ("pv_uv", ["window_start", "window_end", "uv"]), "pv_uv": ("pv_uv", None), "pv_uv_approx": ("uv_approx", None),
    "channel_promo": ("channel_promo", None), "ad_by_region": ("ad_by_region", None),
    "ad_blacklist_counts": ("ad_blacklist_counts", None), "login_fail": ("login_fail", None),
    "order_timeout": ("order_timeout", None), "reconcile": ("reconcile", None), "reconcile_ok": ("reconcile_ok", None),
    "temp_rising": ("temp_rising", None), "temp_split": ("temp_split", None),
    "uv_bloom": ("uv_bloom", None), "window_extremes": ("window_extremes", None), "sliding_uv": ("sliding_uv", None),
    "user_sessions": ("user_sessions", None), "last_view": ("last_view", None),
}


@pytest.fixture(scope="module")
def events_source(spark):
    """A small folder of events in out-of-order files. The sentinel is of a type and a user that
    no job keeps, so results only come out if event time moves before the filters and joins."""
    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = spark.createDataFrame(ev.orderBy("ts", "event_id").collect(), ev.schema)
    far = sentinel_of(ev, "ts", shift=timedelta(days=90), user_id=-1, event_id=-1, event_type="other", value=0.0)
    return sf, lambda: as_stream(spark, ev, "ts", chunks=3, sentinel=far)


@pytest.mark.parametrize("name", sorted(SAME_ROWS))
def test_stream_job_equals_batch_query(spark, events_source, name, monkeypatch):
    from streamwatch.plans.jobs import JOBS, P
    monkeypatch.setitem(P["window_extremes"], "slide", "1 minute")  # fewer rows than at 5 seconds
    from streamwatch.plans.streams import STREAM_JOBS
    sf, source = events_source
    query, cols = SAME_ROWS[name]
    got = run_available(STREAM_JOBS[name](source(), spark, sf, delay="15 days"))
    want = JOBS[query](spark, sf)
    cols = cols or sorted(want.columns)
    want = want.select(*[F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in want.dtypes])
    if "user_id" in got.columns:
        got = got.where("user_id <> -1 or user_id is null")
    if query in ("temp_split", "hot_pages", "sliding_uv"):  # these keep events of every type: not the sentinel's own
        last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]
        time_col = "ts" if "ts" in got.columns else "window_start"
        got = got.where(F.col(time_col) <= F.lit(last).cast("timestamp"))
    expected = rows_of(want, cols)
    assert expected and rows_of(got, cols) == expected


def test_silent_sensor_alarms_by_timer(spark, events_source):
    """The timer rule gives every alarm of the evidence rule, and those of sensors that fall silent."""
    from streamwatch.plans.streams import STREAM_JOBS
    sf, source = events_source
    evidence = run_available(STREAM_JOBS["temp_rising"](source(), spark, sf, delay="15 days"))
    timer = run_available(STREAM_JOBS["temp_rising_timer"](source(), spark, sf, delay="15 days"))
    cols = ["user_id", "run_start", "alarm_ts"]
    assert set(rows_of(evidence, cols)) < set(rows_of(timer, cols))


def test_chained_counts_with_many_overlaps(spark):
    """Windowed counts chained on the blacklist's event time, at 720 overlaps as at 12."""
    ad = load(spark, "ad_click")
    batch_kept = click_blacklist(ad, ["user_id", "ad_id"], "event_time", 100)[0]
    for slide in ("5 minutes", "5 seconds"):
        s = as_stream(spark, ad, "event_time", chunks=3, sentinel=sentinel_of(ad, "event_time", user_id=-1, ad_id=-1))
        kept = stream_blacklist(s, ["user_id", "ad_id"], "event_time", 100, delay="2 hours").where("kind = 'kept'")
        counts = stream_window_count(kept, "event_time", ["ad_id"], "1 hour", slide, delay=None)
        assert counts.columns == ["window", "window_start", "window_end", "ad_id", "n"]
        got = run_available(counts.drop("window")).where("ad_id <> -1")
        assert rows_of(got) == rows_of(window_count(batch_kept, "event_time", ["ad_id"], "1 hour", slide))


def test_late_rows_are_counted(spark):
    """Rows behind the watermark are dropped and counted (stateful operators report them)."""
    from streamwatch.streaming.runner import late_rows
    login = load(spark, "login")
    s = as_stream(spark, login, "event_time", chunks=6, late_frac=0.5)
    out = stream_consecutive(s, "user_id", "event_time", F.col("event_type") == "fail", 2, "2 seconds",
                             delay="1 second")
    q = (out.writeStream.format("memory").queryName(f"late_{random.randrange(10**9)}")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="sw-late-")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert late_rows(q) > 0


def test_stream_restarts_from_checkpoint(spark):
    """Stop after part of the input, restart on the same checkpoint: state and timers carry over."""
    o = load(spark, "order")
    rows = o.collect()
    d = tempfile.mkdtemp(prefix="sw-restart-")
    src, out, ck = os.path.join(d, "src"), os.path.join(d, "out"), os.path.join(d, "ck")
    half = len(rows) // 2
    spark.createDataFrame(rows[:half], o.schema).coalesce(1).write.parquet(os.path.join(src, "a"))
    first, second = F.col("event_type") == "create", F.col("event_type") == "pay"

    def run():
        s = stream_parquet(spark, src + "/*", o.schema, max_files_per_trigger=1)
        q = (stream_followed_by(s, "order_id", "event_time", first, second, "900 seconds", delay="20 minutes")
             .writeStream.format("parquet").option("checkpointLocation", ck)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()

    run()
    time.sleep(1.1)
    spark.createDataFrame(rows[half:], o.schema).coalesce(1).write.parquet(os.path.join(src, "b"))
    time.sleep(1.1)
    spark.createDataFrame([sentinel_of(o, "event_time", order_id=-1)], o.schema).coalesce(1) \
        .write.parquet(os.path.join(src, "c"))
    run()  # a new query object on the same checkpoint
    got = spark.read.parquet(out).where("order_id <> -1")
    want = followed_by_within(o, "order_id", "event_time", first, second, "900 seconds")
    assert rows_of(got) == rows_of(want.select(*got.columns))


def test_stream_blacklist_then_window_counts(spark):
    """Kept rows of the stream blacklist feed a windowed count on the processor's event time."""
    ad = load(spark, "ad_click")
    s = as_stream(spark, ad, "event_time", chunks=5, sentinel=sentinel_of(ad, "event_time", user_id=-1))
    kept = stream_blacklist(s, ["user_id", "ad_id"], "event_time", 100, delay="2 hours").where("kind = 'kept'")
    got = run_available(stream_window_count(kept, "event_time", ["ad_id"], "1 hour", delay=None)
                        .drop("window")).where("ad_id IS NOT NULL")
    batch_kept = click_blacklist(ad, ["user_id", "ad_id"], "event_time", 100)[0]
    want = window_count(batch_kept, "event_time", ["ad_id"], "1 hour")
    assert rows_of(got) == rows_of(want)


def test_row_behind_the_current_watermark_is_still_ordered(spark):
    """A pair split over two batches alerts though the second row is behind the second batch's watermark:
    nothing of its key has been drained beyond it yet, and Spark accepts it."""
    from datetime import datetime
    from streamwatch.streaming.runner import late_rows
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[(1, at(100), "fail"), (2, at(110), "success")], [(1, at(101), "fail")], [(3, at(90000), "success")]]
    d = tempfile.mkdtemp(prefix="sw-stream-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, event_time timestamp, event_type string").coalesce(1).write.parquet(
            os.path.join(d, f"chunk{i}"))
        time.sleep(1.1)
    s = stream_parquet(spark, d + "/*", "user_id long, event_time timestamp, event_type string", max_files_per_trigger=1)
    out = stream_consecutive(s, "user_id", "event_time", F.col("event_type") == "fail", 2, "2 seconds", delay="1 second")
    assert run_available(out).where("user_id = 1").count() == 1


def test_split_output_has_no_row_twice_after_a_failure(spark, monkeypatch):
    """The side output of a batch fails once; the batch runs again and overwrites what it had written."""
    from pyspark.sql.readwriter import DataFrameWriter
    from streamwatch.streaming.joins import write_split
    login = load(spark, "login")
    d = tempfile.mkdtemp(prefix="sw-split-")
    login.coalesce(1).write.parquet(os.path.join(d, "in", "a"))
    main, side = os.path.join(d, "main"), os.path.join(d, "side")
    save, failed = DataFrameWriter.save, []

    def once(self, path=None, *a, **k):
        if path and path.startswith(side) and not failed:
            failed.append(path)
            raise OSError("disk lost")
        return save(self, path, *a, **k)
    monkeypatch.setattr(DataFrameWriter, "save", once)
    for last in (False, True):
        s = stream_parquet(spark, os.path.join(d, "in") + "/*", login.schema, max_files_per_trigger=1)
        q = write_split(s, F.col("event_type") == "fail", main, side, name="twice", trigger={"availableNow": True})
        try:
            q.awaitTermination()
        except Exception:
            assert not last
    assert failed and spark.read.parquet(main).count() == 9 and spark.read.parquet(side).count() == 39

"""Late rows, bounded blacklist state, reconciliation by stretches, and order across many drains."""

import os
import random
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwatch.operators.blacklist import click_blacklist
from streamwatch.operators.joins import reconcile
from streamwatch.operators.windows import window_count
from streamwatch.streaming.late import LateRowCounter, mark_late
from streamwatch.streaming.processors import stream_blacklist, stream_followed_by, stream_reconcile
from streamwatch.streaming.runner import run_available, stream_parquet
from streamwatch.streaming.windows import stream_window_count
from streamwatch.streaming.joins import write_split
from test_streaming import as_stream, rows_of, sentinel_of

DAY = datetime(2024, 1, 1)


def files_of(spark, batches, schema):
    d = tempfile.mkdtemp(prefix="sw-late-")
    for i, rows in enumerate(batches):
        add_file(spark, d, f"c{i:02d}", rows, schema)
    return d


def add_file(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, name))
    time.sleep(0.05)


def at(seconds):
    return DAY + timedelta(seconds=seconds)


LATE = "id long, ts timestamp, name string"


def late_batches(seed=4, n=8, size=60):
    """Times rise by 100 s a batch; a fifth of the rows lie up to 600 s back."""
    r = random.Random(seed)
    return [[(100 * b + i, at(100 * b + r.uniform(0, 100) - (r.uniform(0, 600) if r.random() < 0.2 else 0) + 1000), r.choice("xyz"))
             for i in range(size)] for b in range(n)]


def test_late_and_kept_rows_are_the_input_across_a_restart(spark):
    batches = late_batches()
    d, out = files_of(spark, batches[:4], LATE), tempfile.mkdtemp(prefix="sw-late-out-")
    main, side = os.path.join(out, "late"), os.path.join(out, "kept")

    def run():
        s = stream_parquet(spark, d + "/*", LATE, max_files_per_trigger=1)
        write_split(mark_late(s, "ts", "30 seconds"), F.col("kind") == "late", main, side, name="late", trigger={"availableNow": True}).awaitTermination()

    run()
    time.sleep(1.1)
    for i, rows in enumerate(batches[4:]):
        add_file(spark, d, f"d{i}", rows, LATE)
    run()  # goes on from the checkpoint, with the watermark it had
    late, kept = spark.read.parquet(main), spark.read.parquet(side)
    assert sorted(r.id for r in late.union(kept).collect()) == sorted(x[0] for b in batches for x in b)
    known = {x[0]: x for b in batches for x in b}
    assert all((r.id, r.ts, r.name) == known[r.id] for r in late.union(kept).collect())
    # the rule itself: at or before the latest time of earlier batches less the delay
    top, want = datetime.min, set()
    for b in batches:
        want |= {x[0] for x in b if top > DAY and x[1] <= top - timedelta(seconds=30)}
        top = max(top, max(x[1] for x in b).replace(microsecond=max(x[1] for x in b).microsecond // 1000 * 1000))
    assert {r.id for r in late.collect()} == want and len(want) > 20


def test_kept_rows_feed_a_window_and_none_is_dropped(spark):
    batches = late_batches(9) + [[(-1, at(10 ** 6), "end")]]
    s = stream_parquet(spark, files_of(spark, batches, LATE) + "/*", LATE, max_files_per_trigger=1)
    counter = LateRowCounter().attach(spark)
    try:
        kept = mark_late(s, "ts", "30 seconds").where("kind = 'ontime'")
        counts = stream_window_count(kept, "event_time", ["name"], "50 seconds", delay=None).drop("window")
        got = run_available(counts).where("name <> 'end'").collect()
    finally:
        counter.detach(spark)
    top, n = None, 0
    for b in batches:
        n += sum(1 for x in b if x[2] != "end" and not (top and x[1] <= top - timedelta(seconds=30)))
        top = max([top or DAY, *[x[1] for x in b]])
    assert sum(r.n for r in got) == n


def test_null_times_are_late_and_taken_names_are_refused(spark):
    d = files_of(spark, [[(1, None, "x"), (2, at(5), "y")]], LATE)
    got = run_available(mark_late(stream_parquet(spark, d + "/*", LATE), "ts")).collect()
    assert sorted((r.id, r.ts, r.kind) for r in got) == [(1, None, "late"), (2, at(5), "ontime")]
    with pytest.raises(ValueError):
        mark_late(stream_parquet(spark, d + "/*", LATE).withColumn("kind", F.lit(1)), "ts")


def test_every_dropped_row_is_counted(spark):
    """The counter sees all progress reports; Spark itself retains one here."""
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    batches = late_batches(5)
    s = stream_parquet(spark, files_of(spark, batches, LATE) + "/*", LATE, max_files_per_trigger=1)
    counter = LateRowCounter().attach(spark)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        out = s.withWatermark("ts", "30 seconds").dropDuplicates(["id", "ts"])
        q = (out.writeStream.format("noop").option("checkpointLocation", tempfile.mkdtemp(prefix="sw-late-")).trigger(availableNow=True).start())
        q.awaitTermination()
        dropped = counter.dropped(q)
        s2 = stream_parquet(spark, files_of(spark, batches, LATE) + "/*", LATE, max_files_per_trigger=1)
        kept = run_available(s2.withWatermark("ts", "30 seconds").dropDuplicates(["id", "ts"])).count()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
        counter.detach(spark)
    assert len(q.recentProgress) <= 1 and dropped > 0 and dropped + kept == sum(map(len, batches))


# ------------------------------------------------------------------ K3

CLICKS = "click_id long, ts timestamp, user_id long, ad_id long, province string, seen timestamp"


@pytest.mark.parametrize("salt", [1, 4])
def test_hot_pair_keeps_limit_plus_one_rows(spark, salt):
    """Half a million clicks of one pair in a day, in no order, beside a few of others: same rows and alerts, small state."""
    n, limit = 500_000, 20
    hot = spark.range(n).select(F.col("id").alias("click_id"), F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(80_000))).alias("ts"),
                                F.lit(1).cast("long").alias("user_id"), F.lit(7).cast("long").alias("ad_id"),
                                F.when(F.col("id") % 5 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("province"),
                                F.timestamp_seconds(F.col("id")).alias("seen"))
    others = hot.where("click_id < 90").withColumn("user_id", F.col("click_id") % 3 + 2).withColumn("click_id", F.col("click_id") + n)
    clicks = hot.unionByName(others)
    d = tempfile.mkdtemp(prefix="sw-hot-")
    clicks.repartition(3, "click_id").write.parquet(os.path.join(d, "a"))
    time.sleep(1.1)
    add_file(spark, d, "z", [(-1, DAY + timedelta(days=9), -1, -1, None, None)], CLICKS)
    s = stream_parquet(spark, d + "/*", CLICKS, max_files_per_trigger=1)
    ck, out = tempfile.mkdtemp(prefix="sw-hot-ck-"), tempfile.mkdtemp(prefix="sw-hot-out-")
    q = (stream_blacklist(s, ["user_id", "ad_id"], "ts", limit, tiebreak="click_id", delay="1 day", keep=["province", "seen"], salt_buckets=salt)
         .writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out))
    q.awaitTermination()
    got = spark.read.parquet(out)
    kept, alerts = click_blacklist(clicks, ["user_id", "ad_id"], "ts", limit, tiebreak="click_id")
    cols = ["user_id", "ad_id", "day", "ts", "click_id", "province", "seen"]
    assert rows_of(got.where("kind = 'kept'"), cols) == rows_of(kept, cols)
    assert rows_of(got.where("kind = 'alert'").select("user_id", "ad_id", "day", "ts")) == rows_of(
        alerts.select("user_id", "ad_id", "day", F.col("alert_ts").alias("ts"))) and alerts.count() == 4
    sizes = []
    for batch in range(3):
        state = (spark.read.format("statestore").option("path", ck).option("batchId", batch).option("operatorId", 0)
                 .option("stateVarName", "days").load())
        sizes += [r[0] for r in state.select(F.size("user_map_value.rows")).collect()]
    assert sizes and max(sizes) <= limit + 1


def test_blacklist_over_many_drains(spark):
    """A short delay: rows are released batch by batch, and a day's count carries over."""
    r = random.Random(2)
    rows = [(i, at(i * 600 + r.randrange(500)), r.randrange(3), 1, "p", None) for i in range(500)]
    df = spark.createDataFrame(rows, CLICKS)
    s = as_stream(spark, df, "ts", chunks=10, late_frac=0, sentinel=sentinel_of(df, "ts", user_id=-1))
    got = run_available(stream_blacklist(s, ["user_id", "ad_id"], "ts", 10, tiebreak="click_id", delay="20 minutes", keep=["province"]))
    kept, alerts = click_blacklist(df, ["user_id", "ad_id"], "ts", 10, tiebreak="click_id")
    assert rows_of(got.where("kind = 'kept' and user_id >= 0").select("click_id", "day", "province")) == rows_of(kept.select("click_id", "day", "province"))
    assert rows_of(got.where("kind = 'alert'").select("click_id")) == rows_of(alerts.select(F.col("alert_click_id").alias("click_id")))
    assert alerts.count() >= 9


# ------------------------------------------------------------------ J1

PAYS, RECEIPTS = "k string, pay_ts timestamp, pay_id long", "k string, receipt_ts timestamp, receipt_id long"


@pytest.mark.parametrize("lower,upper,stretch", [("-30 seconds", "30 seconds", "2 minutes"), ("60 seconds", "300 seconds", None),
                                                  ("-200 seconds", "-10 seconds", "1 minute"), ("0 seconds", "0 seconds", "10 seconds"),
                                                  ("-3 microseconds", "20 seconds", "7 seconds")])
def test_reconcile_by_stretches_equals_batch(spark, lower, upper, stretch):
    r = random.Random(hash(lower) % 100 + 1)
    keys = ["hot"] * 8 + ["a", "b", None]
    pays = sorted(((r.choice(keys), at(r.randrange(3000)), i) for i in range(260)), key=lambda x: x[1])
    receipts = sorted(((r.choice(keys), at(r.randrange(3000)), i) for i in range(260)), key=lambda x: x[1])
    p, c = spark.createDataFrame(pays, PAYS), spark.createDataFrame(receipts, RECEIPTS)
    want = reconcile(p, c, "k", "pay_ts", "receipt_ts", lower, upper)
    sp = as_stream(spark, p, "pay_ts", chunks=6, seed=2, sentinel=sentinel_of(p, "pay_ts", k="end"))
    sc = as_stream(spark, c, "receipt_ts", chunks=6, seed=3, sentinel=sentinel_of(c, "receipt_ts", k="end"))
    got = run_available(stream_reconcile(sp, sc, "k", "pay_ts", "receipt_ts", lower, upper, "pay_id", "receipt_id", "20 minutes", stretch))
    cols = ["k", "kind", "pay_ts", "pay_id", "receipt_ts", "receipt_id"]
    assert rows_of(got.where("k is null or k <> 'end'"), cols) == rows_of(want, cols)


# ------------------------------------------------------------------ C2

def test_forgotten_firsts(spark):
    """With ``forget`` a second long after the last first is unmatched, and no state is left of the key."""
    rows = [(1, at(0), "create"), (1, at(50), "pay"), (1, at(400), "pay"), (1, at(5000), "pay"), (2, at(4900), "create"), (2, at(8000), "pay")]
    schema = "order_id long, ts timestamp, kind string"
    df = spark.createDataFrame(rows, schema)
    first, second = F.col("kind") == "create", F.col("kind") == "pay"
    ck, out = tempfile.mkdtemp(prefix="sw-forget-"), tempfile.mkdtemp(prefix="sw-forget-")
    s = as_stream(spark, df, "ts", chunks=6, late_frac=0, sentinel=sentinel_of(df, "ts", order_id=-1, kind="pay"))
    q = (stream_followed_by(s, "order_id", "ts", first, second, "60 seconds", delay="10 seconds", forget="1 hour")
         .writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out))
    q.awaitTermination()
    got = sorted((r.order_id, r.kind, r.first_ts, r.second_ts) for r in spark.read.parquet(out).where("order_id > 0 and kind <> 'timeout'").collect())
    assert [(x[0], x[1]) for x in got] == [(1, "matched"), (1, "unmatched_second")] and got[1][3] == at(5000)
    assert spark.read.parquet(out).where("order_id = 2 and kind = 'timeout'").count() == 1


# ------------------------------------------------------------------ jobs, hours of delay

@pytest.mark.parametrize("name", ["login_fail", "order_timeout", "reconcile", "temp_rising", "ad_blacklist_counts"])
def test_jobs_in_order_over_many_drains(spark, name):
    """Files follow each other in time and the delay is hours, so timers fire in every batch."""
    from streamwatch.plans.jobs import JOBS
    from streamwatch.plans.streams import STREAM_JOBS
    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = spark.createDataFrame(ev.orderBy("ts", "event_id").collect(), ev.schema)
    far = sentinel_of(ev, "ts", shift=timedelta(days=90), user_id=-1, event_id=-1, event_type="other", value=0.0)
    got = run_available(STREAM_JOBS[name](as_stream(spark, ev, "ts", chunks=6, late_frac=0, sentinel=far), spark, sf, delay="2 hours"))
    want = JOBS[name](spark, sf)
    want = want.select(*[F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in want.dtypes])
    if "user_id" in got.columns:
        got = got.where("user_id <> -1 or user_id is null")
    assert rows_of(got, sorted(want.columns)) == rows_of(want)

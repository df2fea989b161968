"""Session windows, as-of joins, corrected results: brute force, hot keys, batches that fail, stream = batch."""

import os
import random
import tempfile
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwatch.operators.asof import asof_join
from streamwatch.operators.sessions import sessions
from streamwatch.operators.windows import window_aggregate
from streamwatch.sources.upserts import compact, read_latest, write_upserts
from streamwatch.streaming.processors import stream_asof
from streamwatch.streaming.runner import run_available, stream_parquet
from streamwatch.streaming.windows import stream_sessions, stream_window_updates
from test_streaming import as_stream, rows_of, sentinel_of

DAY = datetime(2024, 1, 1)
EVENTS = "ts timestamp, key string, v double"


def at(seconds):
    return DAY + timedelta(seconds=seconds)


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for ts, k, _ in rows:
        if ts is not None:
            by[k].append(ts)
    out = []
    for k, times in by.items():
        times.sort()
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if (t - last).total_seconds() > gap:
                out.append((k, start, last + timedelta(seconds=gap), n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last + timedelta(seconds=gap), n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", ["1 second", "1 minute", "1 day"])
def test_sessions_equal_brute_force(spark, bucket):
    r = random.Random(5)
    rows = [(at(r.choice([r.randrange(9000), r.randrange(100) * 30])), r.choice(["a", "b", None]), 0.0) for _ in range(500)]
    rows += [(at(30 * i), "hot", 0.0) for i in range(400)] + [(at(29 * i), "chain", 0.0) for i in range(400)] + [(None, "a", 0.0), (at(5), "one", 0.0)]
    got = sessions(spark.createDataFrame(rows, EVENTS), "key", "ts", "30 seconds", bucket).collect()
    assert sorted(((x.key, x.session_start, x.session_end, x.n) for x in got), key=repr) == brute_sessions(rows, 30)
    native = spark.createDataFrame(rows, EVENTS).groupBy("key", F.session_window("ts", "30 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(((x.key, x.w.start, x.w.end, x.n) for x in native.collect()), key=repr) == brute_sessions(rows, 30)
    assert sessions(spark.createDataFrame([], EVENTS), "key", "ts", "30 seconds").count() == 0
    with pytest.raises(ValueError):
        sessions(spark.createDataFrame([], EVENTS), "key", "ts", "0 seconds")


def test_stream_sessions_equal_batch(spark):
    r = random.Random(6)
    df = spark.createDataFrame(sorted(((at(r.randrange(6000)), r.choice("ab"), 0.0) for _ in range(200)), key=lambda x: x[0]), EVENTS)
    s = as_stream(spark, df, "ts", chunks=4, sentinel=sentinel_of(df, "ts", key="end"))
    got = run_available(stream_sessions(s, "key", "ts", "40 seconds", "2 hours")).where("key <> 'end'")
    assert rows_of(got) == rows_of(sessions(df, "key", "ts", "40 seconds"))


PRICES, ORDERS = "key string, price_ts timestamp, price_id long, price double", "key string, order_ts timestamp, order_id long"


def asof_rows(seed):
    r = random.Random(seed)
    keys = ["hot"] * 5 + ["a", None]
    prices = [(r.choice(keys), at(r.randrange(4000)) if r.random() < 0.97 else None, i, float(i)) for i in range(150)]
    orders = [(r.choice([*keys, "none"]), at(r.randrange(4000)) if r.random() < 0.97 else None, i) for i in range(200)]
    return prices, orders


def brute_asof(prices, orders, tolerance):
    out = []
    for k, t, i in orders:
        best = max(((pt, pid, p) for pk, pt, pid, p in prices if k is not None and pk == k and t is not None and pt is not None and pt <= t), default=None)
        if best and tolerance is not None and (t - best[0]).total_seconds() > tolerance:
            best = None
        out.append((k, t, i, *(best or (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tolerance", [None, 60])
@pytest.mark.parametrize("bucket", ["20 seconds", "1 hour"])
def test_asof_equals_brute_force(spark, tolerance, bucket):
    prices, orders = asof_rows(7)
    got = asof_join(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(prices, PRICES), "key", "order_ts", "price_ts",
                    tolerance and f"{tolerance} seconds", tiebreak="price_id", bucket=bucket)
    assert got.columns == ["key", "order_ts", "order_id", "price_ts", "price_id", "price"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_asof(prices, orders, tolerance)


def test_asof_edges(spark):
    prices, orders = asof_rows(8)
    p, o = spark.createDataFrame(prices, PRICES), spark.createDataFrame(orders, ORDERS)
    assert asof_join(o.limit(0), p, "key", "order_ts", "price_ts").count() == 0
    none = asof_join(o, p.limit(0), "key", "order_ts", "price_ts")
    assert none.count() == len(orders) and none.where("price is not null").count() == 0
    with pytest.raises(ValueError):
        asof_join(o.withColumn("price", F.lit(1)), p, "key", "order_ts", "price_ts")


@pytest.mark.parametrize("tolerance", [None, "60 seconds"])
def test_stream_asof_equals_batch(spark, tolerance):
    prices, orders = asof_rows(9)
    prices, orders = (sorted((x for x in rows if x[1]), key=lambda x: x[1]) for rows in (prices, orders))
    p, o = spark.createDataFrame(prices, PRICES), spark.createDataFrame(orders, ORDERS)
    want = asof_join(o, p, "key", "order_ts", "price_ts", tolerance, tiebreak="price_id")
    sp = as_stream(spark, p, "price_ts", chunks=5, sentinel=sentinel_of(p, "price_ts", key="end"))
    so = as_stream(spark, o, "order_ts", chunks=5, seed=2, sentinel=sentinel_of(o, "order_ts", key="end"))
    got = run_available(stream_asof(so, sp, "key", "order_ts", "price_ts", tolerance, tiebreak="price_id", delay="30 minutes"))
    assert rows_of(got.where("key is null or key <> 'end'"), want.columns) == rows_of(want, want.columns)


# ------------------------------------------------------------------ corrected results

def test_late_rows_correct_windows_that_are_out(spark, monkeypatch):
    """A batch fails half way and runs again; late rows within the lateness correct their windows; one row a window stays."""
    from pyspark.sql.readwriter import DataFrameWriter
    r = random.Random(3)
    batches = [[(at(60 * b + r.randrange(60) - (r.randrange(200) if r.random() < 0.3 else 0) + 500), r.choice("ab"), float(r.randrange(50)))
                for _ in range(40)] for b in range(5)]
    d, out = tempfile.mkdtemp(prefix="sw-up-"), os.path.join(tempfile.mkdtemp(prefix="sw-up-"), "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(os.path.join(d, f"c{i}"))
        time.sleep(0.05)
    save, failed = DataFrameWriter.save, []

    def once(self, path=None, *a, **k):
        save(self, path, *a, **k)
        if path and path.endswith("epoch=2") and not failed:
            failed.append(path)
            raise OSError("lost after writing")
    monkeypatch.setattr(DataFrameWriter, "save", once)
    spec = {"n": ("count", "v"), "low": ("min", "v"), "total": ("sum", "v")}
    for last in (False, True):
        s = stream_parquet(spark, d + "/*", EVENTS, max_files_per_trigger=1)
        q = write_upserts(stream_window_updates(s, "ts", ["key"], "1 minute", lateness="1 hour", **spec), out, trigger={"availableNow": True})
        try:
            q.awaitTermination()
        except Exception:
            assert not last
    monkeypatch.setattr(DataFrameWriter, "save", save)
    keys = ["window_start", "window_end", "key"]
    got = read_latest(spark, out, keys, versions=True)
    want = window_aggregate(spark.createDataFrame([x for b in batches for x in b], EVENTS), "ts", ["key"], "1 minute", **spec)
    assert failed and rows_of(got.select(want.columns)) == rows_of(want)
    assert got.where("n_versions > 1 and first_epoch < epoch").count() > 3  # corrected after they were out
    done = os.path.join(os.path.dirname(out), "compact")
    compact(spark, out, keys, done, upto=4)
    assert rows_of(read_latest(spark, done, keys).select(want.columns)) == rows_of(want)


def test_rows_beyond_the_lateness_change_nothing(spark):
    batches = [[(at(1000), "a", 1.0)], [(at(9000), "a", 1.0)], [(at(9060), "a", 1.0)], [(at(1001), "a", 5.0), (at(8990), "a", 7.0)]]
    d, out = tempfile.mkdtemp(prefix="sw-up-"), os.path.join(tempfile.mkdtemp(prefix="sw-up-"), "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(os.path.join(d, f"c{i}"))
        time.sleep(0.05)
    s = stream_parquet(spark, d + "/*", EVENTS, max_files_per_trigger=1)
    write_upserts(stream_window_updates(s, "ts", ["key"], "1 minute", lateness="10 minutes", n=("count", "v")), out, trigger={"availableNow": True}).awaitTermination()
    got = {x.window_start: x.n for x in read_latest(spark, out, ["window_start", "window_end", "key"]).collect()}
    assert got == {at(960): 1, at(9000): 1, at(9060): 1, at(8940): 1}
    with pytest.raises(ValueError):
        write_upserts(s.withColumn("epoch", F.lit(1)), out)

"""Operator properties: plan equivalences, bucket splitting, ties, edges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwatch.functions.panes import slide_panes, split_factor
from streamwatch.operators.joins import interval_join, reconcile
from streamwatch.operators.patterns import consecutive, followed_by_within
from streamwatch.operators.topn import window_topn
from streamwatch.operators.windows import window_count

BASE = datetime(2024, 1, 1)


def _events(spark, n=400, users=5, seed=7, span_s=6 * 3600, types=("a", "b")):
    rnd = random.Random(seed)
    rows = []
    used = set()
    for i in range(n):
        u = rnd.randrange(users)
        t = rnd.randrange(span_s)
        while (u, t) in used:
            t = rnd.randrange(span_s)
        used.add((u, t))
        rows.append((i, BASE + timedelta(seconds=t), u, rnd.choice(types), float(rnd.randrange(50))))
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, kind string, value double")


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_factor():
    assert split_factor(720) in (24, 30)
    assert split_factor(12) == 1
    assert split_factor(97) in (1, 97)


@pytest.mark.parametrize("size,slide", [("10 minutes", "1 minute"), ("1 hour", "5 minutes"),
                                        ("30 minutes", "30 minutes"), ("2 hours", "10 seconds")])
def test_window_plans_agree_with_native(spark, size, slide):
    ev = _events(spark)
    native = window_count(ev, "ts", ["user_id"], size, slide, method="native")
    sweep = window_count(ev, "ts", ["user_id"], size, slide, plan="sweep")
    fan = window_count(ev, "ts", ["user_id"], size, slide, plan="fanout")
    assert _same(native, sweep) and _same(native, fan)
    assert dict(sweep.dtypes)["window_start"] == "timestamp_ntz"


def test_window_count_empty_and_null_keys(spark):
    ev = _events(spark, n=50)
    empty = ev.where("false")
    assert window_count(empty, "ts", ["user_id"], "1 hour", "5 seconds").count() == 0
    nulls = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("user_id")))
    a = window_count(nulls, "ts", ["user_id"], "20 minutes", "1 minute", method="native")
    b = window_count(nulls, "ts", ["user_id"], "20 minutes", "1 minute")
    assert _same(a, b)
    assert a.where("user_id IS NULL").count() > 0


def test_topn_ties_break_by_key(spark):
    rows = [(BASE, k, n) for k, n in [(5, 3), (2, 3), (9, 3), (1, 1), (7, 4)]]
    df = spark.createDataFrame(rows, "window_start timestamp_ntz, key long, n long")
    got = [(r.key, r.rank) for r in window_topn(df, 3, ["key"]).orderBy("rank").collect()]
    assert got == [(7, 1), (2, 2), (5, 3)]


@pytest.mark.parametrize("times,within", [(2, "10 minutes"), (3, "30 minutes"), (2, "1 second")])
def test_consecutive_bucket_split_is_exact(spark, times, within):
    ev = _events(spark, n=600, users=3, types=("fail", "ok"))
    pred = F.col("kind") == "fail"
    whole = consecutive(ev, "user_id", "ts", pred, times, within, tiebreak="event_id", bucket="3650 days")
    tight = consecutive(ev, "user_id", "ts", pred, times, within, tiebreak="event_id", bucket=within)
    narrow = consecutive(ev, "user_id", "ts", pred, times, within, tiebreak="event_id", bucket="45 seconds")
    assert _same(whole, tight) and _same(whole, narrow)
    assert whole.count() > 0 or within == "1 second"


def test_followed_by_bucket_split_is_exact(spark):
    ev = _events(spark, n=600, users=4, types=("create", "pay", "other"))
    args = (ev, "user_id", "ts", F.col("kind") == "create", F.col("kind") == "pay", "20 minutes")
    whole = followed_by_within(*args, tiebreak="event_id", bucket="3650 days")
    tight = followed_by_within(*args, tiebreak="event_id", bucket="20 minutes")
    narrow = followed_by_within(*args, tiebreak="event_id", bucket="70 seconds")
    assert _same(whole, tight) and _same(whole, narrow)
    kinds = {r.kind for r in whole.select("kind").distinct().collect()}
    assert {"matched", "timeout"} <= kinds


def test_interval_join_bucket_width_does_not_matter(spark):
    ev = _events(spark, n=500, users=4, types=("l", "r"))
    left = ev.where("kind = 'l'").select("user_id", F.col("ts").alias("lt"), F.col("event_id").alias("lid"))
    right = ev.where("kind = 'r'").select("user_id", F.col("ts").alias("rt"), F.col("event_id").alias("rid"))
    a = interval_join(left, right, "user_id", "lt", "rt", "-7 minutes", "13 minutes")
    b = interval_join(left, right, "user_id", "lt", "rt", "-7 minutes", "13 minutes", bucket="90 seconds")
    brute = left.join(right, "user_id").where(
        (F.col("rt") >= F.col("lt") - F.expr("INTERVAL 7 MINUTES")) &
        (F.col("rt") <= F.col("lt") + F.expr("INTERVAL 13 MINUTES")))
    assert _same(a, brute) and _same(b, brute) and a.count() > 0


def test_reconcile_null_keys_never_match(spark):
    pays = spark.createDataFrame([(None, BASE), ("x", BASE)], "k string, pt timestamp_ntz")
    recs = spark.createDataFrame([(None, BASE), ("x", BASE)], "k string, rt timestamp_ntz")
    r = {(x.k, x.kind) for x in reconcile(pays, recs, "k", "pt", "rt", -5, 5).collect()}
    assert r == {("x", "matched"), (None, "pay_only"), (None, "receipt_only")}


@pytest.mark.parametrize("bucket", ["5 minutes", "1 hour", "3650 days"])
def test_rising_bucketed_scan_equals_single_pass(spark, bucket):
    from streamwatch.operators.rising import rising_alarm
    rnd = random.Random(3)
    rows, t = [], {}
    for i in range(1500):
        u = rnd.randrange(4)
        t[u] = t.get(u, 0) + rnd.choice([1, 2, 5, 30, 400])
        v = None if rnd.random() < 0.02 else float(rnd.choice([0, 1, 1, 1, 2, 3]) + t[u] // 50)
        rows.append((i, BASE + timedelta(seconds=t[u]), u, v))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    single = rising_alarm(df, "user_id", "ts", "value", "3 minutes", "event_id", method="single")
    multi = rising_alarm(df, "user_id", "ts", "value", "3 minutes", "event_id", bucket=bucket)
    assert single.count() > 0
    assert _same(single, multi)


@pytest.mark.parametrize("block", [None, 3, 50, 1 << 16])
def test_sweep_blocks_agree(spark, block):
    from streamwatch.functions.panes import pane_counts, sweep
    ev = _events(spark, n=500, users=3)
    panes = pane_counts(ev, "ts", ["user_id"], "1 minute")
    fan = slide_panes(panes, ["user_id"], 20, method="fanout")
    assert _same(fan, sweep(panes, ["user_id"], 20, block=block))


@pytest.mark.parametrize("kind", ["decimal(10,2)", "double", "long"])
@pytest.mark.parametrize("block", [None, 7])
def test_window_sums_keep_zero_negative_fractional_and_null(spark, kind, block):
    rows = [("a", 100, "0.6"), ("a", 160, "0.6"), ("a", 220, "0.8"), ("b", 100, "5"), ("b", 170, "-5"),
            ("c", 100, None), ("c", 400, "-2"), (None, 90, "1")]
    df = (spark.createDataFrame(rows, "key string, s long, x string")
          .select("key", F.timestamp_seconds("s").alias("ts"), F.col("x").cast("double").cast(kind).alias("x")))
    got, want = (window_count(df, "ts", ["key"], "5 minutes", "1 minute", weight="x", method=m, block=block) for m in ("panes", "native"))
    show = lambda d: sorted((str(r.key), r.window_start, None if r.n is None else round(float(r.n), 9)) for r in d.collect())
    assert show(got) == show(want) and len(show(got)) == want.count() > 0


from datetime import datetime, timedelta

from pyspark.sql import functions as F

from streamwatch.operators.blacklist import click_blacklist
from streamwatch.operators.joins import interval_join, reconcile
from streamwatch.operators.patterns import consecutive, followed_by_within
from streamwatch.operators.rising import rising_alarm

T0 = datetime(2024, 1, 1, 12, 0, 0)


def ts(sec: float):
    return T0 + timedelta(seconds=sec)


def test_interval_bounds_are_inclusive(spark):
    pays = spark.createDataFrame([("a", ts(0))], "k string, pt timestamp_ntz")
    recs = spark.createDataFrame([("a", ts(5)), ("a", ts(-5)), ("a", ts(5.000001)), ("a", ts(-5.000001))],
                                 "k string, rt timestamp_ntz")
    got = sorted(r.rt for r in interval_join(pays, recs, "k", "pt", "rt", -5, 5).collect())
    assert got == [ts(-5), ts(5)]
    kinds = sorted(r.kind for r in reconcile(pays, recs, "k", "pt", "rt", -5, 5).collect())
    assert kinds == ["matched", "matched", "receipt_only", "receipt_only"]


def test_followed_by_deadline_is_inclusive(spark):
    rows = [("a", ts(0), "c", 1), ("a", ts(900), "p", 2),          # exactly at the deadline: matched
            ("b", ts(0), "c", 3), ("b", ts(900.000001), "p", 4),   # just after: timeout, pay not orphan
            ("c", ts(10), "p", 5), ("c", ts(10), "c", 6)]          # same time: the create comes first
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, e string, id long")
    r = {(x.k, x.kind) for x in followed_by_within(df, "k", "t", F.col("e") == "c", F.col("e") == "p",
                                                   "900 seconds", tiebreak="id").collect()}
    assert r == {("a", "matched"), ("b", "timeout"), ("c", "matched")}


def test_consecutive_ties_follow_the_tiebreak(spark):
    # same second: fail(id 2) then success(id 3) -> fail, success, fail: no two adjacent fails
    rows = [(1, ts(0), "fail"), (2, ts(1), "fail"), (3, ts(1), "ok"), (4, ts(2), "fail")]
    df = spark.createDataFrame([(i, "u", t, e) for i, t, e in rows], "id long, u string, t timestamp_ntz, e string")
    got = [(r.first_id, r.last_id) for r in
           consecutive(df, "u", "t", F.col("e") == "fail", 2, "2 seconds", tiebreak="id").collect()]
    assert got == [(1, 2)]
    flipped = df.withColumn("id", F.when(F.col("id") == 2, 3).when(F.col("id") == 3, 2).otherwise(F.col("id")))
    got = sorted((r.first_id, r.last_id) for r in
                 consecutive(flipped, "u", "t", F.col("e") == "fail", 2, "2 seconds", tiebreak="id").collect())
    assert got == [(3, 4)]


def test_equal_value_breaks_a_rise(spark):
    vals = [(0, 1.0), (2, 2.0), (4, 2.0), (6, 3.0), (8, 4.0), (10, 5.0), (12, 6.0)]
    df = spark.createDataFrame([("s", ts(t), v) for t, v in vals], "s string, t timestamp_ntz, v double")
    r = rising_alarm(df, "s", "t", "v", "6 seconds").collect()
    assert [(x.run_start, x.alarm_ts) for x in r] == [(ts(6), ts(12))]
    assert rising_alarm(df, "s", "t", "v", "7 seconds").count() == 0


def test_blacklist_exact_limit_and_duplicates(spark):
    rows = [("u", 1, ts(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "u string, ad long, t timestamp_ntz")
    kept, alerts = click_blacklist(df, ["u", "ad"], "t", limit=3)
    assert kept.count() == 3 and alerts.count() == 0
    dup = df.unionByName(df.limit(1))  # an exact duplicate counts as a click
    kept, alerts = click_blacklist(dup, ["u", "ad"], "t", limit=3)
    assert kept.count() == 3 and alerts.count() == 1


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, t timestamp_ntz, e string, id long, v double")
    assert consecutive(e, "k", "t", F.col("e") == "x", 2, "1 hour").count() == 0
    assert followed_by_within(e, "k", "t", F.col("e") == "a", F.col("e") == "b", "1 hour").count() == 0
    assert rising_alarm(e, "k", "t", "v", "1 hour").count() == 0
    assert reconcile(e.select("k", F.col("t").alias("a")), e.select("k", F.col("t").alias("b")),
                     "k", "a", "b", -5, 5).count() == 0
    kept, alerts = click_blacklist(e, ["k"], "t", 2)
    assert kept.count() == 0 and alerts.count() == 0

"""Golden results on the reference's sample logs (expected values: FIXTURES.md)."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from conftest import fixture_path
from streamwatch.operators.blacklist import click_blacklist
from streamwatch.operators.joins import interval_join, reconcile
from streamwatch.operators.patterns import consecutive, followed_by_within
from streamwatch.operators.rising import rising_alarm
from streamwatch.operators.split import split_by
from streamwatch.operators.windows import pv_uv, window_count
from streamwatch.sources.logs import read_log


def epoch(ts) -> int:
    return int(ts.replace(tzinfo=timezone.utc).timestamp())


def load(spark, kind):
    return read_log(spark, kind, fixture_path(kind))


def test_logs_parse_with_fixed_schema(spark):
    counts = {k: load(spark, k).count() for k in ("ad_click", "login", "order", "receipt")}
    assert counts == {"ad_click": 143, "login": 48, "order": 79, "receipt": 40}
    order = load(spark, "order")
    assert order.where("event_type = 'create' AND tx_id IS NULL").count() == 39
    assert order.where("event_type = 'pay' AND tx_id IS NOT NULL").count() == 40


def test_ad_clicks_per_hour_pv_uv(spark):
    r = pv_uv(load(spark, "ad_click"), "event_time", "user_id", "1 hour").collect()
    got = {epoch(x.window_start): (x.pv, x.uv) for x in r}
    assert got == {1511658000: (9, 9), 1511661600: (134, 4)}


def test_province_counts_per_hour(spark):
    r = window_count(load(spark, "ad_click"), "event_time", ["province"], "1 hour").collect()
    got = {(epoch(x.window_start), x.province): x.n for x in r}
    assert got == {
        (1511658000, "guangdong"): 5, (1511658000, "beijing"): 2, (1511658000, "shanghai"): 2,
        (1511661600, "beijing"): 121, (1511661600, "zhejiang"): 5, (1511661600, "jiangsu"): 4,
        (1511661600, "henan"): 3, (1511661600, "hebei"): 1,
    }


def test_province_sliding_1h_5s_both_plans(spark):
    ad = load(spark, "ad_click")
    sweep = window_count(ad, "event_time", ["province"], "1 hour", "5 seconds", plan="sweep")
    fan = window_count(ad, "event_time", ["province"], "1 hour", "5 seconds", plan="fanout")
    assert sweep.count() == 5991
    assert sweep.agg(F.max("n")).first()[0] == 122
    assert sweep.exceptAll(fan).count() == 0 and fan.exceptAll(sweep).count() == 0


def test_blacklist_limit_100_per_day(spark):
    kept, alerts = click_blacklist(load(spark, "ad_click"), ["user_id", "ad_id"], "event_time",
                                   limit=100, scope="day")
    assert kept.count() == 122
    a = alerts.collect()
    assert len(a) == 1
    assert (a[0].user_id, a[0].ad_id, epoch(a[0].alert_ts)) == (937166, 1715, 1511661701)


def test_login_two_failures_within_2s(spark):
    login = load(spark, "login")
    r = consecutive(login, "user_id", "event_time", F.col("event_type") == "fail", 2, "2 seconds")
    got = sorted((x.user_id, epoch(x.first_ts), epoch(x.last_ts)) for x in r.collect())
    assert got == [(1035, 1558430842, 1558430843), (1035, 1558430843, 1558430844)]
    r3 = consecutive(login, "user_id", "event_time", F.col("event_type") == "fail", 3, "2 seconds")
    assert [(x.user_id, epoch(x.first_ts), epoch(x.last_ts)) for x in r3.collect()] == \
        [(1035, 1558430842, 1558430844)]
    assert consecutive(login, "user_id", "event_time", F.col("event_type") == "fail", 3,
                       "1 second").count() == 0


def test_order_timeout_900s(spark):
    o = load(spark, "order")
    r = followed_by_within(o, "order_id", "event_time", F.col("event_type") == "create",
                           F.col("event_type") == "pay", "900 seconds").collect()
    kinds = {}
    for x in r:
        kinds.setdefault(x.kind, []).append(x.order_id)
    assert len(kinds["matched"]) == 37
    assert sorted(kinds["timeout"]) == [34756, 34767]
    assert kinds["unmatched_second"] == [34768]


def _pays_receipts(spark):
    pays = load(spark, "order").where("event_type = 'pay'").select(
        "tx_id", F.col("order_id"), F.col("event_time").alias("pay_time"))
    rec = load(spark, "receipt").select("tx_id", "pay_channel", F.col("event_time").alias("rec_time"))
    return pays, rec


def test_reconcile_5s_and_30min(spark):
    pays, rec = _pays_receipts(spark)
    r = reconcile(pays, rec, "tx_id", "pay_time", "rec_time", "-5 seconds", "5 seconds")
    counts = {x.kind: x["count"] for x in r.groupBy("kind").count().collect()}
    assert counts == {"matched": 5, "pay_only": 35, "receipt_only": 35}
    r = reconcile(pays, rec, "tx_id", "pay_time", "rec_time", "-30 minutes", "30 minutes").collect()
    by = {}
    for x in r:
        by.setdefault(x.kind, set()).add(x.tx_id)
    assert len(by["matched"]) == 38
    assert by["pay_only"] == {"35jue34we", "88snrn932"}
    assert by["receipt_only"] == {"ewr342as4", "8fdsfae83"}


def test_interval_join_ranges(spark):
    pays, rec = _pays_receipts(spark)
    expect = {(-3, 5): 4, (-5, 5): 5, (-15, 20): 14, (-20, 15): 18, (-60, 60): 32, (-151, 5): 36}
    for (lo, hi), n in expect.items():
        got = interval_join(pays, rec, "tx_id", "pay_time", "rec_time", lo, hi).count()
        assert got == n, (lo, hi, got)


def _sensor(spark):
    rows = []
    s1 = [10, 11, 12, 13, 14, 15, 16, 15, 16, 17, 16, 17, 18, 19, 20]
    for i, v in enumerate(s1):
        rows.append(("s1", 1000 + 2 * i, float(v)))
    for i in range(8):
        rows.append(("s2", 1000 + 2 * i, float(100 - i)))
    df = spark.createDataFrame(rows, "sensor_id string, ts long, temperature double")
    return df.withColumn("event_time", F.timestamp_seconds("ts"))


def test_rising_alarm_synthetic(spark):
    r = rising_alarm(_sensor(spark), "sensor_id", "event_time", "temperature", "10 seconds").collect()
    assert [(x.sensor_id, epoch(x.run_start), epoch(x.alarm_ts)) for x in r] == [("s1", 1002, 1012)]


def test_split_login_fail_success(spark):
    main, side = split_by(load(spark, "login"), F.col("event_type") == "fail")
    assert (main.count(), side.count()) == (9, 39)

"""The jobs on the sample logs (CSV): 3.5 to 3.9 on the four logs with data, 2.1, 2.2 and
3.1 to 3.4 on the four that are described only.

Each job takes ``log``, a function from a log's kind to its DataFrame with the event
time ``event_time``. If that is a stream (with its watermark set), the job's stream
form runs; otherwise the batch form. Both return the same columns.

Parameters the reference states: one-hour windows, five-second updates (3.5), two
failures within two seconds (3.7), 15 minutes (3.8), ten seconds of rising (2.1).
The others are DECISIONs, kept in ``P``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panes import SWEEP_BLOCK
from ..functions.time import after_watermark
from ..operators.blacklist import click_blacklist
from ..operators.joins import interval_join, reconcile as reconcile_op
from ..operators.patterns import consecutive, followed_by_within
from ..operators.rising import rising_alarm
from ..operators.split import threshold_split
from ..operators.topn import window_topn
from ..operators.windows import pv_uv as pv_uv_op, window_count
from ..sources.logs import read_log
from ..streaming.joins import stream_interval_join
from ..streaming.processors import (stream_blacklist, stream_consecutive, stream_followed_by, stream_reconcile,
                                    stream_rising)
from ..streaming.windows import stream_pv_uv, stream_topn, stream_window_count
from .jobs import ORDER_KINDS

P = {
    "ad_by_region": {"size": "1 hour", "slide": "5 seconds"},
    "ad_blacklist": {"limit": 100, "size": "1 hour", "slide": "5 seconds"},
    "login_fail": {"times": 2, "within": "2 seconds"},
    "order_timeout": {"within": "15 minutes"},
    "reconcile": {"lower": "-5 seconds", "upper": "5 seconds"},
    "temp_rising": {"duration": "10 seconds"},
    "temp_split": {"threshold": 60.0},
    "hot_items": {"size": "1 hour", "slide": "5 minutes", "top": 3},
    "hot_pages": {"size": "1 minute", "slide": "5 seconds", "top": 5},
    "pv_uv": {"size": "1 hour"},
    "channel_promo": {"size": "1 hour", "exclude": "uninstall"},
}

T = "event_time"
Log = Callable[[str], DataFrame]


def logs_in(spark: SparkSession, folder: str, streaming: bool = False, delay="10 minutes",
            max_files_per_trigger: int | None = None) -> Log:
    """Logs read from ``<kind>*.csv`` files in one folder."""
    return lambda kind: read_log(spark, kind, folder, streaming, event_time=T, delay=delay if streaming else None,
                                 max_files_per_trigger=max_files_per_trigger, pattern=f"{kind}*.csv")


def _where(df: DataFrame, pred) -> DataFrame:
    # on a stream the filter stays above the watermark, so that every row moves event time
    return df.where(after_watermark(pred, T) if df.isStreaming else pred)


def _count(df: DataFrame, keys: list[str], size, slide=None) -> DataFrame:
    if df.isStreaming:
        return stream_window_count(df, T, keys, size, slide, delay=None).drop("window")
    return window_count(df, T, keys, size, slide, block=SWEEP_BLOCK if slide else None)


def _top(df: DataFrame, key: str, p: dict) -> DataFrame:
    if df.isStreaming:
        return stream_topn(stream_window_count(df, T, [key], p["size"], p["slide"], delay=None), p["top"], [key])
    return window_topn(_count(df, [key], p["size"], p["slide"]), p["top"], [key])


def ad_by_region(log: Log) -> DataFrame:
    p = P["ad_by_region"]
    return _count(log("ad_click"), ["province"], p["size"], p["slide"])


def _blacklist(log: Log, kind: str) -> DataFrame:
    ad, keys, limit = log("ad_click"), ["user_id", "ad_id"], P["ad_blacklist"]["limit"]
    if ad.isStreaming:
        return stream_blacklist(ad, keys, T, limit, delay=None, keep=["province"]).where(F.col("kind") == kind)
    kept, alerts = click_blacklist(ad, keys, T, limit, scope="day")
    return kept if kind == "kept" else alerts


def ad_blacklist_alerts(log: Log) -> DataFrame:
    """(user_id, ad_id, day, alert_ts) of users who click an ad more than ``limit`` times a day."""
    out = _blacklist(log, "alert")
    return out.select("user_id", "ad_id", "day", (F.col(T).alias("alert_ts") if out.isStreaming else "alert_ts"))


def ad_blacklist_counts(log: Log) -> DataFrame:
    """Clicks kept by the blacklist, per province and window."""
    p = P["ad_blacklist"]
    return _count(_blacklist(log, "kept"), ["province"], p["size"], p["slide"])


def login_fail(log: Log) -> DataFrame:
    login, p, failed = log("login"), P["login_fail"], F.col("event_type") == "fail"
    if login.isStreaming:
        r = stream_consecutive(login, "user_id", T, failed, p["times"], p["within"], delay=None)
    else:
        r = consecutive(login, "user_id", T, failed, p["times"], p["within"])
    return r.select("user_id", "first_ts", "last_ts")


def order_timeout(log: Log) -> DataFrame:
    orders, within = log("order"), P["order_timeout"]["within"]
    create, pay = F.col("event_type") == "create", F.col("event_type") == "pay"
    if orders.isStreaming:
        r = stream_followed_by(orders, "order_id", T, create, pay, within, delay=None)
    else:
        r = followed_by_within(orders, "order_id", T, create, pay, within)
    kind = F.create_map(*[F.lit(x) for kv in ORDER_KINDS.items() for x in kv])[F.col("kind")]
    return r.select("order_id", kind.alias("kind"), F.col("first_ts").alias("create_ts"), F.col("second_ts").alias("pay_ts"))


def _pays_receipts(log: Log) -> tuple[DataFrame, DataFrame]:
    pays = _where(log("order"), F.col("event_type") == "pay").select("tx_id", F.col(T).alias("pay_ts"), "order_id")
    return pays, log("receipt").select("tx_id", F.col(T).alias("receipt_ts"), F.xxhash64("pay_channel").alias("receipt_id"))


def reconcile(log: Log) -> DataFrame:
    """Receipts have no number of their own; ``receipt_id`` is a hash of their channel."""
    pays, receipts = _pays_receipts(log)
    p = P["reconcile"]
    if pays.isStreaming:
        r = stream_reconcile(pays, receipts, "tx_id", "pay_ts", "receipt_ts", p["lower"], p["upper"], "order_id",
                             "receipt_id", delay=None)
    else:
        r = reconcile_op(pays, receipts, "tx_id", "pay_ts", "receipt_ts", p["lower"], p["upper"])
    return r.select("tx_id", "kind", "pay_ts", "order_id", "receipt_ts", "receipt_id")


def reconcile_ok(log: Log) -> DataFrame:
    pays, receipts = _pays_receipts(log)
    p = P["reconcile"]
    if pays.isStreaming:
        return stream_interval_join(pays, receipts, "tx_id", "pay_ts", "receipt_ts", p["lower"], p["upper"], None, None)
    return interval_join(pays, receipts, "tx_id", "pay_ts", "receipt_ts", p["lower"], p["upper"])


def temp_rising(log: Log) -> DataFrame:
    sensor, duration = log("sensor"), P["temp_rising"]["duration"]
    if sensor.isStreaming:
        return stream_rising(sensor, "sensor_id", T, "temperature", duration, delay=None)
    return rising_alarm(sensor, "sensor_id", T, "temperature", duration)


def temp_split(log: Log) -> DataFrame:
    return threshold_split(log("sensor"), "temperature", P["temp_split"]["threshold"])


def hot_items(log: Log) -> DataFrame:
    return _top(_where(log("user_behavior"), F.col("behavior") == "pv"), "item_id", P["hot_items"])


def hot_pages(log: Log) -> DataFrame:
    return _top(log("page_access"), "url", P["hot_pages"])


def pv_uv(log: Log) -> DataFrame:
    views = _where(log("user_behavior"), F.col("behavior") == "pv")
    size = P["pv_uv"]["size"]
    return stream_pv_uv(views, T, "user_id", size, delay=None) if views.isStreaming else pv_uv_op(views, T, "user_id", size)


def channel_promo(log: Log) -> DataFrame:
    p = P["channel_promo"]
    rows = _where(log("app_marketing"), F.col("behavior") != p["exclude"])
    return _count(rows, ["channel", "behavior"], p["size"])


LOG_JOBS = {f.__name__: f for f in (
    ad_by_region, ad_blacklist_alerts, ad_blacklist_counts, login_fail, order_timeout, reconcile, reconcile_ok,
    temp_rising, temp_split, hot_items, hot_pages, pv_uv, channel_promo)}

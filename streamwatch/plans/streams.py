"""The jobs as streaming queries over a streaming ``events`` source.

Same bindings and parameters as ``plans.jobs`` (``P``); each function takes a
streaming DataFrame with the ``events`` schema and returns a streaming
DataFrame to be written with ``sources.sinks.write`` (append mode). The
watermark delay bounds how late an event may arrive. It is set on the events
as they come in, before any filter or join, so event time moves with every
event; filters are written so that they stay above it (``after_watermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import after_watermark, with_delay
from ..operators.split import threshold_split
from ..sources.tables import prop_k, user_channel, user_province
from ..streaming.joins import stream_interval_join
from ..streaming.processors import (stream_asof, stream_blacklist, stream_consecutive, stream_followed_by,
                                    stream_reconcile, stream_rising)
from ..streaming.windows import (stream_pv_uv as stream_pv_uv_op, stream_pv_uv_approx, stream_sessions, stream_sliding_uv, stream_topn, stream_uv_bloom,
                                  stream_uv_exact, stream_window_aggregate, stream_window_count)
from .jobs import ORDER_KINDS, P, UNKNOWN

DEFAULT_DELAY = "10 minutes"


def events_stream(spark: SparkSession, source_dir: str, pattern: str = "events*.parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of the ``events`` parquet files in ``source_dir`` (new files are new
    micro-batches); ``ts`` is cast to ``timestamp``, which watermarks need."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source_dir).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _marked(ev: DataFrame, delay, pred=None) -> DataFrame:
    ev = with_delay(ev, "ts", delay)
    return ev if pred is None else ev.where(after_watermark(pred, "ts"))


def hot_items(ev: DataFrame, spark: SparkSession, sf_dir: str, delay=DEFAULT_DELAY) -> DataFrame:
    p = P["hot_items"]
    views = _marked(ev, delay, F.col("event_type") == "view").select("ts", prop_k().alias("item_id"))
    counts = stream_window_count(views, "ts", ["item_id"], p["size"], p["slide"], delay=None)
    return stream_topn(counts, p["top"], ["item_id"])


def hot_pages(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["hot_pages"]
    pages = ev.select("ts", prop_k().alias("address"))
    return stream_topn(stream_window_count(pages, "ts", ["address"], p["size"], p["slide"], delay),
                       p["top"], ["address"])


def uv(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return stream_uv_exact(_marked(ev, delay, F.col("event_type") == "view"), "ts", "user_id",
                           P["pv_uv"]["size"], delay=None)


def pv_uv(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return stream_pv_uv_op(_marked(ev, delay, F.col("event_type") == "view"), "ts", "user_id",
                           P["pv_uv"]["size"], delay=None)


def pv_uv_approx(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return stream_pv_uv_approx(_marked(ev, delay, F.col("event_type") == "view"), "ts", "user_id",
                               P["pv_uv"]["size"], delay=None)


def uv_bloom(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return stream_uv_bloom(_marked(ev, delay, F.col("event_type") == "view"), "ts", "user_id", P["pv_uv"]["size"], delay=None)


def window_extremes(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["window_extremes"]
    out = stream_window_aggregate(ev.select("ts", "event_type", "value"), "ts", ["event_type"], p["size"], p["slide"], delay,
                                  n=("count", "value"), low=("min", "value"), high=("max", "value"), mean=("avg", "value"))
    return out.withColumn("mean", F.round("mean", 6))


def sliding_uv(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["sliding_uv"]
    return stream_sliding_uv(ev.select("ts", "user_id"), "ts", "user_id", p["size"], p["slide"], delay)


def channel_promo(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    """Stream-static join to the customer dimension, then windowed counts."""
    p = P["channel_promo"]
    rows = (_marked(ev, delay, F.col("event_type") != p["exclude"])
              .select("ts", "user_id", F.col("event_type").alias("behavior"))
              .join(user_channel(spark, sf_dir), "user_id", "left")
              .withColumn("channel", F.coalesce("channel", F.lit(UNKNOWN))))
    return stream_window_count(rows, "ts", ["channel", "behavior"], p["size"], p["slide"], delay=None).drop("window")


def _with_province(ev, spark, sf_dir):
    return (ev.select("ts", "user_id").join(user_province(spark, sf_dir), "user_id", "left")
              .withColumn("province", F.coalesce("province", F.lit(UNKNOWN))))


def ad_by_region(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["ad_by_region"]
    clicks = _with_province(_marked(ev, delay, F.col("event_type") == "click"), spark, sf_dir)
    return stream_window_count(clicks, "ts", ["province"], p["size"], p["slide"], delay=None).drop("window")


def ad_blacklist(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    """Kept rows and alerts, tagged by ``kind``."""
    return stream_blacklist(ev.select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"],
                            "ts", P["ad_blacklist"]["limit"], tiebreak="event_id", delay=delay)


def ad_blacklist_counts(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    """Kept rows of the blacklist, counted per province and window (chained on its event time)."""
    p = P["ad_blacklist"]
    kept = ad_blacklist(ev, spark, sf_dir, delay).where(F.col("kind") == "kept")
    rows = _with_province(kept, spark, sf_dir)
    return stream_window_count(rows, "ts", ["province"], p["size"], p["slide"], delay=None).drop("window")


def login_fail(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["login_fail"]
    return stream_consecutive(ev, "user_id", "ts", F.col("event_type") == "error", p["times"], p["within"],
                              tiebreak="event_id", delay=delay).select("user_id", "first_ts", "last_ts")


def order_timeout(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    r = stream_followed_by(ev, "user_id", "ts", F.col("event_type") == "signup",
                           F.col("event_type") == "purchase", P["order_timeout"]["within"],
                           tiebreak="event_id", delay=delay)
    kind = F.create_map(*[F.lit(x) for kv in ORDER_KINDS.items() for x in kv])[F.col("kind")]
    return r.select("user_id", kind.alias("kind"), F.col("first_ts").alias("create_ts"),
                    F.col("second_ts").alias("pay_ts"), F.col("first_event_id").alias("create_id"),
                    F.col("second_event_id").alias("pay_id"))


def _pays_receipts(ev, delay):
    pays = _marked(ev, delay, F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("pay_ts"), F.col("event_id").alias("pay_id"))
    receipts = _marked(ev, delay, F.col("event_type") == "click").select(
        "user_id", F.col("ts").alias("receipt_ts"), F.col("event_id").alias("receipt_id"))
    return pays, receipts


def reconcile(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["reconcile"]
    pays, receipts = _pays_receipts(ev, delay)
    return stream_reconcile(pays, receipts, "user_id", "pay_ts", "receipt_ts", p["lower"], p["upper"],
                            "pay_id", "receipt_id", delay=None)


def reconcile_ok(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    p = P["reconcile"]
    pays, receipts = _pays_receipts(ev, delay)
    return stream_interval_join(pays, receipts, "user_id", "pay_ts", "receipt_ts", p["lower"], p["upper"],
                                None, None)


def temp_rising(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return stream_rising(ev, "user_id", "ts", "value", P["temp_rising"]["duration"], tiebreak="event_id",
                         delay=delay)


def temp_rising_timer(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    """The timer rule: a sensor that goes silent after rising alarms too."""
    return stream_rising(ev, "user_id", "ts", "value", P["temp_rising"]["duration"], tiebreak="event_id",
                         delay=delay, alarm="timer")


def user_sessions(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return stream_sessions(ev.select("ts", "user_id"), "user_id", "ts", P["user_sessions"]["gap"], delay)


def last_view(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    bought = _marked(ev, delay, F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"))
    seen = _marked(ev, delay, F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return stream_asof(bought, seen, "user_id", "buy_ts", "view_ts", P["last_view"]["tolerance"], tiebreak="view_id", delay=None)


def temp_split(ev, spark, sf_dir, delay=DEFAULT_DELAY):
    return threshold_split(ev.select("event_id", "ts", "user_id", "value"), "value",
                           P["temp_split"]["threshold"])


STREAM_JOBS = {
    "hot_items": hot_items, "hot_pages": hot_pages, "uv": uv, "pv_uv": pv_uv, "pv_uv_approx": pv_uv_approx,
    "uv_bloom": uv_bloom, "window_extremes": window_extremes, "sliding_uv": sliding_uv,
    "channel_promo": channel_promo, "ad_by_region": ad_by_region, "ad_blacklist": ad_blacklist,
    "ad_blacklist_counts": ad_blacklist_counts,
    "login_fail": login_fail, "order_timeout": order_timeout, "reconcile": reconcile,
    "reconcile_ok": reconcile_ok, "temp_rising": temp_rising,
    "temp_rising_timer": temp_rising_timer, "temp_split": temp_split,
    "user_sessions": user_sessions, "last_view": last_view,
}

"""The reference's jobs, bound to the test tables (batch forms).

Each job is ``(spark, sf_dir) -> DataFrame`` over the whole ``events`` table
(and the customer / nation dimensions). The bindings and every parameter the

=================  ===========================================================
hot_items (3.1)    item = props.k of 'view' events; 1 h window every 5 min; top 3
hot_pages (3.2)    address = props.k of all events; 1 min every 5 s; top 5
pv_uv (3.3)        'view' events; 1 h tumbling; PV, exact UV (and HLL UV)
channel_promo      channel = customer market segment, behaviour = event_type;
  (3.4)            'error' events filtered out; 1 h tumbling
ad_by_region       'click' events; province = customer's nation; 1 h every 5 s
  (3.5)
ad_blacklist       ad = event_type; (user, ad) per UTC day, limit 2; kept
  (3.6)            rows counted per province, 1 h every 5 min
login_fail (3.7)   fail = 'error'; 2 consecutive within 1 h (and 3 within 6 h)
order_timeout      create = 'signup', pay = 'purchase', key user_id; 12 h
  (3.8)
reconcile (3.9)    pay = 'purchase', receipt = 'click', key user_id; +-6 h
temp_rising (2.1)  sensor = user_id, temperature = value; 12 h
temp_split (2.2)   high when value > 100, else low
=================  ===========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panes import SWEEP_BLOCK, pane_counts
from ..functions.time import ts_type
from ..operators.asof import asof_join
from ..operators.blacklist import click_blacklist
from ..operators.joins import interval_join, reconcile as reconcile_op
from ..operators.patterns import consecutive, followed_by_within
from ..operators.rising import rising_alarm
from ..operators.sessions import sessions
from ..operators.split import threshold_split
from ..operators.sql import register
from ..operators.topn import window_topn
from ..operators.windows import pv_uv as pv_uv_op, sliding_uv as sliding_uv_op, uv_approx as uv_approx_op, uv_bloom as uv_bloom_op, \
    window_aggregate, window_count, window_quantiles as window_quantiles_op, windows_from_panes
from ..sources.tables import events, prop_k, user_channel, user_province

P = {
    "hot_items": {"size": "1 hour", "slide": "5 minutes", "top": 3},
    "hot_pages": {"size": "1 minute", "slide": "5 seconds", "top": 5},
    "pv_uv": {"size": "1 hour"},
    "value_balance": {"size": "1 hour", "slide": "5 minutes"},
    "window_extremes": {"size": "1 hour", "slide": "5 seconds"},
    "window_quantiles": {"size": "1 hour", "slide": "5 minutes"},
    "sliding_uv": {"size": "1 hour", "slide": "5 minutes"},
    "channel_promo": {"size": "1 hour", "slide": None, "exclude": "error"},
    "ad_rollup": {"size": "1 hour", "slide": "5 minutes"},
    "ad_by_region": {"size": "1 hour", "slide": "5 seconds"},
    "ad_blacklist": {"limit": 2, "size": "1 hour", "slide": "5 minutes"},
    "login_fail": {"times": 2, "within": "1 hour"},
    "login_fail_3in6h": {"times": 3, "within": "6 hours"},
    "order_timeout": {"within": "12 hours"},
    "reconcile": {"lower": "-6 hours", "upper": "6 hours"},
    "temp_rising": {"duration": "12 hours"},
    "temp_split": {"threshold": 100.0},
    "user_sessions": {"gap": "6 hours"},
    "last_view": {"tolerance": "2 days"},
}


#: Channel or province of events whose user has no customer row.
UNKNOWN = "unknown"


def _rank_int(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("int"))


# 3.1 hot items -------------------------------------------------------------
def hot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P["hot_items"]
    ev = events(spark, sf_dir).where(F.col("event_type") == "view").select(
        "ts", prop_k().alias("item_id"))
    # An item's time axis has about 105,000 five-minute panes a year: less than two blocks.
    counts = window_count(ev, "ts", ["item_id"], p["size"], p["slide"])
    return _rank_int(window_topn(counts, p["top"], ["item_id"]))


# 3.2 hot pages -------------------------------------------------------------
def hot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P["hot_pages"]
    ev = events(spark, sf_dir).select("ts", prop_k().alias("address"))
    counts = window_count(ev, "ts", ["address"], p["size"], p["slide"], block=SWEEP_BLOCK)
    return _rank_int(window_topn(counts, p["top"], ["address"]))


# sums of a signed measure per window -------------------------------------
def value_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole part of ``value`` above or below 50, summed per window and event type:
    sums may be zero or negative."""
    p = P["value_balance"]
    ev = events(spark, sf_dir).select("ts", "event_type", (F.floor("value") - F.lit(50)).alias("w"))
    return window_count(ev, "ts", ["event_type"], p["size"], p["slide"], weight="w", out="balance", block=SWEEP_BLOCK)


# aggregates that cannot be subtracted --------------------------------------
def window_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, smallest, largest and mean ``value`` of each event type, 1 h windows every 5 s."""
    p = P["window_extremes"]
    ev = events(spark, sf_dir).select("ts", "event_type", "value")
    out = window_aggregate(ev, "ts", ["event_type"], p["size"], p["slide"], n=("count", "value"), low=("min", "value"),
                           high=("max", "value"), mean=("avg", "value"))
    return out.withColumn("mean", F.round("mean", 6))


def window_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90 % quantile of ``value`` of each event type."""
    p = P["window_quantiles"]
    ev = events(spark, sf_dir).select("ts", "event_type", "value")
    return window_quantiles_op(ev, "ts", ["event_type"], p["size"], p["slide"], "value", {"p50": 0.5, "p90": 0.9})


def sliding_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users of all events, 1 h windows every 5 min."""
    p = P["sliding_uv"]
    return sliding_uv_op(events(spark, sf_dir).select("ts", "user_id"), "ts", "user_id", p["size"], p["slide"], block=SWEEP_BLOCK)


# 3.3 PV / UV ---------------------------------------------------------------
def _views(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("event_type") == "view").select("ts", "user_id")


def pv_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv_uv_op(_views(spark, sf_dir), "ts", "user_id", P["pv_uv"]["size"])


def uv_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uv_approx_op(_views(spark, sf_dir), "ts", "user_id", P["pv_uv"]["size"])


def uv_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uv_bloom_op(_views(spark, sf_dir), "ts", "user_id", P["pv_uv"]["size"])


def pv_uv_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job through a view and Spark SQL (P5)."""
    register(events(spark, sf_dir), "sw_events")
    return spark.sql(f"""
        SELECT window.start AS window_start, window.end AS window_end,
               count(*) AS pv, count(DISTINCT user_id) AS uv
        FROM sw_events WHERE event_type = 'view'
        GROUP BY window(ts, '{P["pv_uv"]["size"]}')""")


# 3.4 marketing by channel --------------------------------------------------
def channel_promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-aggregate per (pane, user, behaviour) before the customer join, so the
    join sees one row per active user and pane instead of one per event."""
    p = P["channel_promo"]
    ev = events(spark, sf_dir)
    like = ts_type(ev, "ts")
    ev = ev.where(F.col("event_type") != p["exclude"]).select(
        "ts", "user_id", F.col("event_type").alias("behavior"))
    slide = p["slide"] or p["size"]
    panes = pane_counts(ev, "ts", ["user_id", "behavior"], slide)
    by_channel = (panes.join(user_channel(spark, sf_dir), "user_id", "left")
                  .withColumn("channel", F.coalesce("channel", F.lit(UNKNOWN)))
                  .groupBy("pane", "channel", "behavior").agg(F.sum("n").alias("n")))
    return windows_from_panes(by_channel, ["channel", "behavior"], p["size"], slide, like)


# 3.5 ad clicks by region ---------------------------------------------------
def _per_province_windows(spark, sf_dir, ev, size, slide, like):
    """Provinces are few and the time axis is long, so the sweep runs in blocks
    (parallel over provinces x blocks instead of provinces)."""
    panes = pane_counts(ev, "ts", ["user_id"], slide)
    by_prov = (panes.join(user_province(spark, sf_dir), "user_id", "left")
               .withColumn("province", F.coalesce("province", F.lit(UNKNOWN)))
               .groupBy("pane", "province").agg(F.sum("n").alias("n")))
    return windows_from_panes(by_prov, ["province"], size, slide, like, block=SWEEP_BLOCK)


def ad_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P["ad_by_region"]
    ev = events(spark, sf_dir)
    like = ts_type(ev, "ts")
    clicks = ev.where(F.col("event_type") == "click").select("ts", "user_id")
    return _per_province_windows(spark, sf_dir, clicks, p["size"], p["slide"], like)


def ad_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clicks per province, per region and in all, 1 h every 5 min: ``grain`` says which.

    Clicks are counted once per (pane, user), joined, and summed for all grains over
    pane totals in one shuffle (grouping sets); windows follow from the totals.
    """
    p = P["ad_rollup"]
    ev = events(spark, sf_dir)
    like = ts_type(ev, "ts")
    panes = pane_counts(ev.where(F.col("event_type") == "click").select("ts", "user_id"), "ts", ["user_id"], p["slide"])
    rows = (panes.join(user_province(spark, sf_dir, region=True), "user_id", "left")
            .select("pane", "n", F.coalesce("region", F.lit(UNKNOWN)).alias("region"), F.coalesce("province", F.lit(UNKNOWN)).alias("province")))
    c = F.col
    sums = (rows.groupingSets([[c("pane"), c("region"), c("province")], [c("pane"), c("region")], [c("pane")]], "pane", "region", "province")
            .agg(F.sum("n").alias("n"), F.grouping_id().alias("_g")))
    grain = F.when(c("_g") == 0, "province").when(c("_g") == 1, "region").otherwise("all").alias("grain")
    by = ["grain", "region", "province"]
    return windows_from_panes(sums.select("pane", grain, "region", "province", "n"), by, p["size"], p["slide"], like, block=SWEEP_BLOCK)


# 3.6 blacklist -------------------------------------------------------------
def _blacklist(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return click_blacklist(ev, ["user_id", "event_type"], "ts", P["ad_blacklist"]["limit"],
                           scope="day", tiebreak="event_id")


def ad_blacklist_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blacklist(spark, sf_dir)[1]


def ad_blacklist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P["ad_blacklist"]
    kept = _blacklist(spark, sf_dir)[0]
    like = ts_type(kept, "ts")
    return _per_province_windows(spark, sf_dir, kept.select("ts", "user_id"), p["size"],
                                 p["slide"], like)


# 3.7 login failures --------------------------------------------------------
def _login_fail(spark, sf_dir, p):
    ev = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return consecutive(ev, "user_id", "ts", F.col("event_type") == "error", p["times"],
                       p["within"], tiebreak="event_id").select("user_id", "first_ts", "last_ts")


def login_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _login_fail(spark, sf_dir, P["login_fail"])


def login_fail_3in6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _login_fail(spark, sf_dir, P["login_fail_3in6h"])


# 3.8 order timeout ---------------------------------------------------------
ORDER_KINDS = {"matched": "paid", "timeout": "timeout", "unmatched_second": "pay_without_create"}


def order_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    r = followed_by_within(ev, "user_id", "ts", F.col("event_type") == "signup",
                           F.col("event_type") == "purchase", P["order_timeout"]["within"],
                           tiebreak="event_id")
    kind = F.create_map(*[F.lit(x) for kv in ORDER_KINDS.items() for x in kv])[F.col("kind")]
    return r.select("user_id", kind.alias("kind"), F.col("first_ts").alias("create_ts"),
                    F.col("second_ts").alias("pay_ts"), F.col("first_event_id").alias("create_id"),
                    F.col("second_event_id").alias("pay_id"))


# 3.9 reconciliation --------------------------------------------------------
def _pays_receipts(spark, sf_dir):
    ev = events(spark, sf_dir)
    pays = ev.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("pay_ts"), F.col("event_id").alias("pay_id"))
    receipts = ev.where(F.col("event_type") == "click").select(
        "user_id", F.col("ts").alias("receipt_ts"), F.col("event_id").alias("receipt_id"))
    return pays, receipts


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P["reconcile"]
    pays, receipts = _pays_receipts(spark, sf_dir)
    return reconcile_op(pays, receipts, "user_id", "pay_ts", "receipt_ts", p["lower"], p["upper"]) \
        .select("user_id", "kind", "pay_ts", "pay_id", "receipt_ts", "receipt_id")


def reconcile_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P["reconcile"]
    pays, receipts = _pays_receipts(spark, sf_dir)
    return interval_join(pays, receipts, "user_id", "pay_ts", "receipt_ts", p["lower"], p["upper"]) \
        .select("user_id", "pay_ts", "pay_id", "receipt_ts", "receipt_id")


# 2.1 / 2.2 sensor jobs -----------------------------------------------------
def temp_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    return rising_alarm(ev, "user_id", "ts", "value", P["temp_rising"]["duration"],
                        tiebreak="event_id")


def temp_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    return threshold_split(ev, "value", P["temp_split"]["threshold"])


# sessions and as-of values -------------------------------------------------
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events at most six hours apart."""
    return sessions(events(spark, sf_dir).select("ts", "user_id"), "user_id", "ts", P["user_sessions"]["gap"])


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it, if no older than two days."""
    ev = events(spark, sf_dir)
    bought = ev.where(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"))
    seen = ev.where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"),
                                                          F.col("value").alias("view_value"))
    return asof_join(bought, seen, "user_id", "buy_ts", "view_ts", P["last_view"]["tolerance"], tiebreak="view_id")


JOBS = {
    "hot_items": hot_items,
    "hot_pages": hot_pages,
    "value_balance": value_balance,
    "window_extremes": window_extremes,
    "window_quantiles": window_quantiles,
    "sliding_uv": sliding_uv,
    "pv_uv": pv_uv,
    "pv_uv_sql": pv_uv_sql,
    "uv_approx": uv_approx,
    "uv_bloom": uv_bloom,
    "channel_promo": channel_promo,
    "ad_by_region": ad_by_region,
    "ad_rollup": ad_rollup,
    "ad_blacklist_alerts": ad_blacklist_alerts,
    "ad_blacklist_counts": ad_blacklist_counts,
    "login_fail": login_fail,
    "login_fail_3in6h": login_fail_3in6h,
    "order_timeout": order_timeout,
    "reconcile": reconcile,
    "reconcile_ok": reconcile_ok,
    "temp_rising": temp_rising,
    "temp_split": temp_split,
    "user_sessions": user_sessions,
    "last_view": last_view,
}

"""Fixed schemas of the four reference logs (S4a-d). No inference anywhere.

The logs are headerless CSV with epoch-second timestamps. Column names are
ours; types were checked against every row.
"""

from pyspark.sql import types as T

AD_CLICK = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("ad_id", T.LongType()),
    T.StructField("province", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("ts", T.LongType()),
])

LOGIN = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("ip", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("ts", T.LongType()),
])

ORDER = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("tx_id", T.StringType()),
    T.StructField("ts", T.LongType()),
])

RECEIPT = T.StructType([
    T.StructField("tx_id", T.StringType()),
    T.StructField("pay_channel", T.StringType()),
    T.StructField("ts", T.LongType()),
])

# Streams the reference describes without data; the column choices are ours.
SENSOR = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("temperature", T.DoubleType()),
])

USER_BEHAVIOR = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("behavior", T.StringType()),
    T.StructField("ts", T.LongType()),
])

PAGE_ACCESS = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
])

APP_MARKETING = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("behavior", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("ts", T.LongType()),
])

LOGS = {
    "ad_click": AD_CLICK, "login": LOGIN, "order": ORDER, "receipt": RECEIPT,
    "sensor": SENSOR, "user_behavior": USER_BEHAVIOR, "page_access": PAGE_ACCESS,
    "app_marketing": APP_MARKETING,
}

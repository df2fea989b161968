"""Property tests (hypothesis): optimized plans equal the obvious ones on random inputs."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamwatch.operators.joins import interval_join
from streamwatch.operators.windows import window_count

BASE = datetime(2024, 1, 1)
events = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4000)), min_size=0, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    data = [(k, BASE + timedelta(seconds=t)) for k, t in rows]
    return spark.createDataFrame(data, "k int, ts timestamp_ntz")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@SETTINGS
@given(rows=events, slide=st.sampled_from([10, 30, 60]), k=st.integers(1, 12), block=st.sampled_from([None, 2, 7]))
def test_sweep_equals_native_window(spark, rows, slide, k, block):
    df = _df(spark, rows)
    size = slide * k
    native = window_count(df, "ts", ["k"], f"{size} seconds", f"{slide} seconds", method="native")
    ours = window_count(df, "ts", ["k"], f"{size} seconds", f"{slide} seconds", block=block)
    cols = ["window_start", "window_end", "k", "n"]
    assert _rows(native.select(*cols)) == _rows(ours.select(*cols))


@SETTINGS
@given(left=events, right=events, lo=st.integers(-300, 300), width=st.integers(0, 600))
def test_interval_join_equals_brute_force(spark, left, right, lo, width):
    hi = lo + width
    L = _df(spark, left).select("k", F.col("ts").alias("lt")).withColumn("lid", F.monotonically_increasing_id())
    R = _df(spark, right).select("k", F.col("ts").alias("rt")).withColumn("rid", F.monotonically_increasing_id())
    L, R = spark.createDataFrame(L.collect(), L.schema), spark.createDataFrame(R.collect(), R.schema)
    ours = interval_join(L, R, "k", "lt", "rt", lo, hi).select("lid", "rid")
    brute = (L.join(R, "k").where((F.unix_micros(F.col("rt").cast("timestamp")) - F.unix_micros(F.col("lt").cast("timestamp")))
                                  .between(lo * 1_000_000, hi * 1_000_000)).select("lid", "rid"))
    assert _rows(ours) == _rows(brute)

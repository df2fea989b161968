"""Windows of measures without an inverse, exact sliding UV and Bloom UV: brute force, hot keys, stream = batch."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwatch.functions.bloom import BITS, bitmap_positions
from streamwatch.functions.combine import HLL, MAX, MIN, SUM, slide_combined
from streamwatch.operators.windows import sliding_uv, uv_bloom, window_aggregate, window_count, window_quantiles
from streamwatch.streaming.runner import run_available
from streamwatch.streaming.windows import stream_sliding_uv, stream_uv_bloom, stream_window_aggregate
from test_streaming import as_stream, rows_of, sentinel_of

EPOCH = datetime(2024, 1, 1)
EVENTS = "ts timestamp, key string, user_id long, value double"


def some_events(n=400, seed=3, span=4000, keys=("a", "b", None), nulls=0.1):
    r = random.Random(seed)
    return [(EPOCH + timedelta(seconds=r.randrange(span), microseconds=r.randrange(10 ** 6)), r.choice(keys), r.randrange(12),
             None if r.random() < nulls else round(r.uniform(-50, 50), 3)) for _ in range(n)]


def windows_of(rows, size, slide):
    """{(start, key): rows} by testing every window start."""
    out = defaultdict(list)
    for row in rows:
        at = int((row[0] - EPOCH).total_seconds() // slide)
        for w in range(at - size // slide + 1, at + 1):
            out[EPOCH + timedelta(seconds=w * slide), row[1]].append(row)
    return out


@pytest.mark.parametrize("k", [2, 3, 12, 61])
def test_combined_panes_equal_brute_force(spark, k):
    r = random.Random(k)
    panes = {(r.choice("ab"), r.randrange(-70, 300)): r.choice([None, round(r.uniform(-9, 9), 2)]) for _ in range(150)}
    df = spark.createDataFrame([(a, p, v, v, v) for (a, p), v in panes.items()], "key string, pane long, low double, high double, total double")
    got = {(x.key, x.pane): (x.low, x.high, x.total) for x in slide_combined(df, ["key"], k, {"low": MIN, "high": MAX, "total": SUM}).collect()}
    want = defaultdict(list)
    for (a, p), v in panes.items():
        for w in range(p - k + 1, p + 1):
            want[a, w].append(v)
    assert set(got) == set(want)
    for x, vs in want.items():
        vs = [v for v in vs if v is not None]
        assert got[x] == ((min(vs), max(vs), pytest.approx(sum(vs), abs=1e-9)) if vs else (None, None, None))


@pytest.mark.parametrize("size,slide", [(600, 60), (60, 60), (720, 8)])
def test_window_aggregate_equals_brute_force(spark, size, slide):
    rows = some_events()
    out = window_aggregate(spark.createDataFrame(rows, EVENTS), "ts", ["key"], f"{size} seconds", f"{slide} seconds", n=("count", "value"),
                           low=("min", "value"), high=("max", "value"), total=("sum", "value"), mean=("avg", "value"), first_user=("min", "user_id"))
    want = windows_of(rows, size, slide)
    got = out.collect()
    assert {(r.window_start, r.key) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        vs = [x[3] for x in want[r.window_start, r.key] if x[3] is not None]
        assert r.n == len(vs) and r.window_end - r.window_start == timedelta(seconds=size)
        assert r.first_user == min(x[2] for x in want[r.window_start, r.key])
        if vs:
            assert (r.low, r.high) == (min(vs), max(vs)) and r.total == pytest.approx(sum(vs)) and r.mean == pytest.approx(sum(vs) / len(vs))
        else:
            assert (r.low, r.high, r.total, r.mean) == (None,) * 4


def test_window_aggregate_edges(spark):
    df = spark.createDataFrame([], EVENTS)
    assert window_aggregate(df, "ts", [], "1 hour", "5 seconds", n=("count", "value")).count() == 0
    one = spark.createDataFrame([(EPOCH, "a", 1, 2.5)], EVENTS)
    got = window_aggregate(one, "ts", [], "1 hour", "5 seconds", low=("min", "value"))
    assert got.count() == 720 and got.where("low = 2.5").count() == 720
    with pytest.raises(ValueError):
        window_aggregate(one, "ts", [], "1 hour", "7 seconds", low=("min", "value"))
    with pytest.raises(ValueError):
        window_aggregate(one, "ts", [], "1 hour", "5 seconds", low=("median", "value"))


def test_groups_are_bounded_by_the_window(spark):
    """No group of the plan holds more than a block's panes and boundaries, and no row is copied k times before the result."""
    k = 720
    panes = spark.range(20 * k).select(F.lit("hot").alias("key"), F.col("id").alias("pane"), F.rand(1).alias("v"))
    out = slide_combined(panes, ["key"], k, {"v": MAX})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_blk" in plan and "Expand" not in plan
    assert out.count() == 21 * k - 1


def test_double_sums_do_not_drift(spark):
    """A huge value leaves no rounding error in the windows after it."""
    rows = [(EPOCH + timedelta(seconds=i), "a", 1, 1e18 if i == 5 else 0.125) for i in range(100)]
    got = window_count(spark.createDataFrame(rows, EVENTS), "ts", ["key"], "10 seconds", "1 second", weight="value", out="s", block=16)
    late = got.where(F.col("window_start") > F.lit(EPOCH + timedelta(seconds=6))).where(F.col("window_end") <= F.lit(EPOCH + timedelta(seconds=100)))
    assert late.count() > 50 and late.where("s <> 1.25").count() == 0


def test_hll_sketches_combine(spark):
    panes = spark.createDataFrame([(p, u) for p in range(30) for u in range(p, p + 5)], "pane long, u long").groupBy("pane").agg(F.hll_sketch_agg("u").alias("s"))
    got = slide_combined(panes, [], 4, {"s": HLL}).select("pane", F.hll_sketch_estimate("s").alias("n")).where("pane between 0 and 26").collect()
    assert len(got) == 27 and all(r.n == 8 for r in got)


def test_quantiles_exact_then_bounded(spark):
    rows = some_events(300)
    got = window_quantiles(spark.createDataFrame(rows, EVENTS), "ts", ["key"], "10 minutes", "1 minute", "value", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()
    want = {x: sorted(v[3] for v in vs if v[3] is not None) for x, vs in windows_of(rows, 600, 60).items()}
    assert {(r.window_start, r.key) for r in got} == {x for x, vs in want.items() if vs}
    for r in got:
        vs = want[r.window_start, r.key]
        for q, v in ((0.1, r.p10), (0.5, r.p50), (1.0, r.p100)):
            assert r.n == len(vs) and v == next(x for i, x in enumerate(vs, 1) if i >= q * len(vs) - 1e-9)
    n = 200_000
    many = spark.range(n).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 7200).alias("ts"), (F.xxhash64("id") % 1_000_000).cast("double").alias("value"))
    big = window_quantiles(many, "ts", [], "1 hour", "10 minutes", "value", {"p50": 0.5, "p99": 0.99}).where("n > 50000").collect()
    values = sorted(r.value for r in many.select("value").collect())
    rank = lambda v: sum(1 for x in values if x <= v) / len(values)
    assert big and all(abs(rank(r.p50) - 0.5) < 0.03 and abs(rank(r.p99) - 0.99) < 0.03 for r in big)


@pytest.mark.parametrize("block", [None, 64])
def test_sliding_uv_equals_count_distinct(spark, block):
    rows = some_events(500, span=30_000) + [(EPOCH + timedelta(seconds=7 * i), "a", 99, 0.0) for i in range(2000)] + [(EPOCH, "a", None, 1.0)]
    df = spark.createDataFrame(rows, EVENTS)
    for keys in ([], ["key"]):
        got = sliding_uv(df, "ts", "user_id", "10 minutes", "1 minute", keys, block=block).collect()
        want = defaultdict(set)
        for (start, key), found in windows_of(rows, 600, 60).items():
            want[(start, key) if keys else (start,)].update(x[2] for x in found if x[2] is not None)
        assert {(r.window_start, r.key) if keys else (r.window_start,): r.uv for r in got} == {x: len(u) for x, u in want.items() if u}
    assert sliding_uv(df.limit(0), "ts", "user_id", "10 minutes", "1 minute").count() == 0


def test_sliding_uv_of_long_silences(spark):
    """Panes in far blocks, one pane a block, and panes a window apart."""
    rows = [(EPOCH + timedelta(minutes=m), "a", u, 0.0) for u in (1, 2) for m in (0, 9, 10, 4095 * (u + 1), 4096 * 3 - 1, 4096 * 3 + 8, 9 * 4096)]
    got = sliding_uv(spark.createDataFrame(rows, EVENTS), "ts", "user_id", "10 minutes", "1 minute").collect()
    want = windows_of(rows, 600, 60)
    assert {r.window_start: r.uv for r in got} == {s: len({x[2] for x in found}) for (s, _), found in want.items()}


def test_bloom_uv_of_a_million_users(spark):
    n = 1_000_000
    users = spark.range(n).select(F.lit(EPOCH).alias("ts"), (F.col("id") * 7 + 3).alias("user_id"))
    twice = users.unionAll(users)
    r = uv_bloom(twice, "ts", "user_id").first()
    assert r.pv == 2 * n and abs(r.uv - n) < 5 * 0.0013 * n
    assert abs(uv_bloom(users.selectExpr("ts", "cast(user_id as string) user_id"), "ts", "user_id").first().uv - n) < 5 * 0.0013 * n
    assert users.limit(1000).select(F.explode(bitmap_positions(F.col("user_id"))).alias("b")).where(f"b < 1 or b > {BITS}").count() == 0


def test_bloom_uv_edges(spark):
    rows = some_events(300) + [(EPOCH, "a", None, 0.0), (EPOCH, "a", -5, 0.0), (EPOCH, "a", 2 ** 62, 0.0), (EPOCH, "a", -2 ** 63, 0.0)]
    got = {r.window_start: (r.pv, r.uv) for r in uv_bloom(spark.createDataFrame(rows, EVENTS), "ts", "user_id", "10 minutes").collect()}
    want = defaultdict(list)
    for x in rows:
        want[EPOCH + timedelta(seconds=(x[0] - EPOCH).total_seconds() // 600 * 600)].append(x[2])
    assert got == {w: (len(u), len(set(u) - {None})) for w, u in want.items()}
    assert uv_bloom(spark.createDataFrame([], EVENTS), "ts", "user_id").count() == 0
    with pytest.raises(ValueError):
        uv_bloom(spark.createDataFrame(rows, EVENTS), "ts", "user_id", bits=1000)


def in_order(spark, rows):
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), EVENTS)


@pytest.mark.parametrize("size,slide", [("10 minutes", "30 seconds"), ("10 minutes", "10 minutes")])
def test_stream_window_aggregate_equals_batch(spark, size, slide):
    rows = [r for r in some_events(300) if r[1]]
    df = in_order(spark, rows + [(EPOCH + timedelta(hours=3), "a", 1, 4.5), (EPOCH + timedelta(hours=5), "b", 1, None)])
    spec = {"n": ("count", "value"), "low": ("min", "value"), "high": ("max", "value"), "total": ("sum", "value"), "last": ("max", "user_id")}
    s = as_stream(spark, df, "ts", chunks=5, sentinel=sentinel_of(df, "ts", key="zz"))
    got = run_available(stream_window_aggregate(s, "ts", ["key"], size, slide, "6 hours", **spec)).where("key <> 'zz'")
    want = window_aggregate(df, "ts", ["key"], size, slide, **spec)
    near = lambda d: rows_of(d.withColumn("total", F.round("total", 6)))
    assert near(got) == near(want.select(*got.columns))


def test_stream_window_aggregate_drains_often(spark):
    """A short delay: windows leave in many drains, between which state carries over."""
    df = in_order(spark, [r for r in some_events(400) if r[1]])
    s = as_stream(spark, df, "ts", chunks=12, sentinel=sentinel_of(df, "ts", key="zz"), late_frac=0)
    got = run_available(stream_window_aggregate(s, "ts", ["key"], "10 minutes", "30 seconds", "1 second", low=("min", "value"), high=("max", "value")))
    assert rows_of(got.where("key <> 'zz'")) == rows_of(window_aggregate(df, "ts", ["key"], "10 minutes", "30 seconds", low=("min", "value"), high=("max", "value")))


def test_stream_uv_forms_equal_batch(spark):
    df = in_order(spark, some_events(300))
    end = sentinel_of(df, "ts", user_id=1)
    closed = F.col("window_start") < F.lit(EPOCH + timedelta(days=1))
    bloom = run_available(stream_uv_bloom(as_stream(spark, df, "ts", sentinel=end), "ts", "user_id", "10 minutes", "6 hours")).where(closed)
    assert rows_of(bloom) == rows_of(uv_bloom(df, "ts", "user_id", "10 minutes"))
    exact = run_available(stream_sliding_uv(as_stream(spark, df, "ts", sentinel=end), "ts", "user_id", "10 minutes", "2 minutes", "6 hours")).where(closed)
    assert rows_of(exact) == rows_of(sliding_uv(df, "ts", "user_id", "10 minutes", "2 minutes"))

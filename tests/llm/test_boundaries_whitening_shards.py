"""Fill-in-middle, whitening and sharding against brute force, on small and odd inputs."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamwatch.llm import fim, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, " \n\t ", "de", None, 4), (None, "the cat", "en", "s", 7),
       (4, "wörter und " * 30000, "de", None, 330000), (5, "the cat sat on the mat", "en", "t", 22), (6, "the cat sat on the mat", "en", "t", 22),
       (7, "一二三 😀 <P> x", "en", "t", 40), (8, "一二三四" * 20000, "zh", "t", 80000), (9, "x" * 70000, "en", "t", 70000)]


def odd(spark):
    d = spark.createDataFrame(ODD, DOCS)
    for c in ("n", "form", "output", "shard", "slot", "size", "start", "_text", "_cuts", "_part", "_tie", "_at", "_first"):
        d = d.withColumn(c, F.lit(5))
    return d


def duck(name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(queries.SQL[name])


def same_as_sql(spark, name):
    rel = duck(name)
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


# ------------------------------------------------------------------ fill in middle

def expected_fim(key, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, text = len(units), text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZ é一😀\n<.\x00"), max_size=60), st.integers(1, 4000))
def test_boundary_set_selects_every_unit(text, times):
    text = text * times
    ends = np.cumsum([len(u) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)])
    found = fim.boundaries(text)
    assert len(found) == len(ends)
    for i in {0, 1, len(ends) // 3, len(ends) // 2, len(ends) - 1} if len(ends) else ():
        if 0 <= i < len(ends):
            assert found.select(i) == ends[i] and found.rank(int(ends[i])) == i + 1
    with pytest.raises(IndexError):
        found.select(len(ends))


def test_all_kinds_of_containers():
    text = "a b" * 40000 + "x" * 200000 + "一" * 150000 + ("x" * 100 + "1") * 1500
    found = fim.boundaries(text)
    assert {type(c) for c in found.containers} == {fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer}
    ends = np.cumsum([len(u) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)])
    assert [found.select(i) for i in range(0, len(ends), 97)] == ends[::97].tolist()
    assert [found.rank(o) for o in range(0, len(text), 9973)] == np.searchsorted(ends, range(0, len(text), 9973), side="right").tolist()


def test_fim_equals_brute_force(spark):
    rows = fim.fill_in_middle(odd(spark))
    assert len(set(rows.columns)) == len(rows.columns) and "lang" in rows.columns
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows.collect()), key=repr)
    assert got == sorted(((r[0], *expected_fim(r[0], r[1])) for r in ODD), key=repr)
    back = rows.select(fim.restore(F.col("output"), F.col("form")).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    assert back.where("t <> text or t is null").count() == 0
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    cut_marks = spark.createDataFrame([(i, ("<P<S <" * (i % 9))[:i]) for i in range(300)], "doc_id long, text string")
    every = fim.fill_in_middle(cut_marks, transformed=100)
    assert every.where(fim.restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0


def test_fim_equals_sql(spark):
    same_as_sql(spark, "op11_fim")


def test_fim_is_linear():
    def seconds(n):
        t, text = time.perf_counter(), "lorem ipsum, " * (n // 13)
        fim.cut_offsets(fim.boundaries(text), 5, n // 4)
        return time.perf_counter() - t
    seconds(100_000)
    assert seconds(4_000_000) < 10 * max(seconds(1_000_000), 0.02)


# ------------------------------------------------------------------ whitening

def test_inertia_counts_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 64):
        a = rng.standard_normal((n, n))
        a = (a + a.T) / 2
        e = np.linalg.eigvalsh(a)
        for s in (*(e[:-1] + np.diff(e) / 2), e[0] - 1, e[-1] + 1):
            assert whitening.above(a, s) == int((e >= s).sum())
        v = rng.standard_normal(n)
        assert np.allclose((a - 0.3 * np.eye(n)) @ whitening.Shifted(a, 0.3).solve(v), v)
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # a block of two rows


@pytest.mark.parametrize("values", [[9, 5, 3, 2, 1, 0.5], [4, 4, 4, 4, 4, 4], [7, 7, 3, 3, 3, 1], [1e12, 1, 1e-3, 1e-9, 0, 0], [5, 5 - 1e-12, 2, 2 - 1e-10, 1, 0],
                                    [3, 0, 0, 0, 0, 0], [1 + i * 1e-7 for i in range(40)]])
def test_leading_pairs(values):
    rng = np.random.default_rng(2)
    n = len(values)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.leading(a, 4)
    top = sorted(values, reverse=True)[:4]
    assert np.allclose(e, top, rtol=1e-12, atol=1e-13 * max(values) * n)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert np.abs(a @ v - v * e).max() <= 1e-13 * max(values) * n


def test_leading_of_degenerate_matrices():
    e, v = whitening.leading(np.zeros((6, 6)))
    assert e.tolist() == [0] * 4 and np.allclose(v.T @ v, np.eye(4))
    e, v = whitening.leading(np.array([[2.0]]))
    assert e.tolist() == [2] and v.tolist() == [[1]]


def reference_whitening(vectors, d):
    xs = [[math.floor(256 * c) for c in v] for v in vectors]
    distinct = sorted(set(map(tuple, xs)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in distinct], dtype=float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:4]
    white = (np.array([[n * c - s for c, s in zip(x, sums)] for x in xs], dtype=float) / n) @ v[:, order] / np.sqrt(e[order])
    return n, [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs], white, e[order] / e.sum()


def check_whitening(rows, ids, vectors, d):
    n, deviations, white, explained = reference_whitening(vectors, d)
    assert len(rows) == 4 * len(ids) and {r.n for r in rows} == {n}
    assert {r.identity_error for r in rows}.__len__() == 1 and rows[0].identity_error < 1e-9
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(4):
        got = np.array([by[i, c + 1][0].whitened for i in ids])
        sign = np.sign(got @ white[:, c])
        assert np.abs(sign * got - white[:, c]).max() < 1e-8
    for i, dev in zip(ids, deviations):
        assert all(r.deviation == dev for c in range(4) for r in by[i, c + 1])
        assert all(abs(r.explained - explained[c]) < 1e-10 for c in range(4) for r in by[i, c + 1])


def test_whitening_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_whitening(whitening.whitening_report(spark.read.parquet(f"{SF}/embeddings.parquet")).collect(),
                    [r.vec_id for r in good], [r.embedding for r in good], 64)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    kind = "vec_id long, embedding array<double>, n int, whitened string, _x int"
    good = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(7)]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(30)] + [(200, [-0.0] * 7), (201, [0.0] * 7)]
    bad = [(300, None), (301, [float("nan")] * 7), (302, [1.0] * 6 + [float("inf")]), (303, [None] * 7), (304, []), (305, [1.0, 2.0]), (306, [1e30] * 7)]
    df = spark.createDataFrame([(i, v, 1, "w", 2) for i, v in good + bad], kind).repartition(5)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "embedding", "_x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out.collect(), [i for i, _ in good], [v for _, v in good], 7)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.limit(0)).columns == out.columns
    twice = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(twice) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in twice)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in flat) == [(v, c, c > 1) for v in (1, 2) for c in (1, 2, 3)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in flat if r.component == 1)


def test_whitening_is_exact_beyond_longs(spark):
    rows = [(i, [float(i % 7) * 2.0 ** 50, float(i * i % 11) * 2.0 ** 50, float(i)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in got) and all(math.isfinite(r.whitened) for r in got if r.component < 3) and got[0].identity_error < 1e-4


# ------------------------------------------------------------------ sharding

def test_sharding_equals_sql(spark):
    same_as_sql(spark, "op13_sharding")


def check_shards(rows, shards):
    """Rows are (order, size, shard, slot, start): contiguous, gapless, each cut at the boundary nearest to its target."""
    rows = sorted(rows, key=lambda r: r[4])
    whole, at = sum(r[1] for r in rows), 0
    slots = {}
    for order, size, shard, slot, start in rows:
        assert start == at and shard == (2 * at + size) * shards // (2 * whole)
        assert slot == slots.get(shard, 0)
        slots[shard] = slot + 1
        at += size
    keys = [(r[0] is not None, r[0] or 0) for r in rows]
    assert keys == sorted(keys)


def test_shards_of_odd_rows(spark):
    out = sharding.shard_documents(odd(spark), 3)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.size == len((r.text or "").encode()) + 8 for r in rows)
    check_shards([(r.doc_id, r.size, r.shard, r.slot, r.start) for r in rows], 3)
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    report = {r.doc_id: r for r in sharding.sharding_report(odd(spark)).collect()}
    assert report[5].text_crc32 == zlib.crc32(b"the cat sat on the mat") and report[1].text_crc32 == 0 and report[1].size == 8


def test_shards_of_a_hot_key_and_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_PARTS", 40)
    rng = random.Random(5)
    rows = [(7 if i % 3 == 0 else None if i % 10 == 1 else rng.randrange(10 ** 12), rng.randrange(1, 500), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, size long, other long")
    bounds = sharding.quantiles(df.where("k is not null"), "k", 40)
    parts = df.select("k", sharding.part_of(F.col("k"), F.xxhash64("k", "other"), bounds).alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 1000 and len(parts) > 35  # 2,000 rows of one key are divided
    got = sharding.assign_shards(df, "k", "size", 24).collect()
    assert len(got) == 6000
    check_shards([(r.k, r.size, r.shard, r.slot, r.start) for r in got], 24)


def test_shards_are_near_equal_and_written(spark, tmp_path):
    out = sharding.shard_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("start")
    by = [r for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()]
    share = sum(r.b for r in by) / 24
    assert len(by) == 24 and all(abs(r.b - share) <= max(x.m for x in by) for r in by)
    sharding.write_shards(out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select(*out.columns).exceptAll(out).count() == 0 and back.count() == 1000


def test_native_operators_use_no_python(spark):
    for name in ("op13_sharding",):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan

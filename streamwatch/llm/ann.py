"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted at random and
ordered along a Hilbert curve, ``ORDERINGS`` times over. Each ordering is cut
into key ranges of about equal size. A query looks at the ranges around its own
place (its window); rows travel as their original components and are ranked by
cosine in double precision, so near copies are told apart, the best of each
range merge, and the best of all are ranked again.

How much a window must hold depends on the data: vectors without structure need
a share of all rows (``WINDOW`` as a fraction), clustered ones a number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamwatch.llm.common import bucket_of, saved

ORDERINGS = 16
DIMS = 12
BITS = 4
TIE_BITS = 15
SEED = 7
#: Rows on either side of a query that it looks at, in each ordering: a share of all (below 1) or a number.
WINDOW = 0.04
#: And at least so many rows, whatever ``WINDOW`` says.
LEAST_WINDOW = 300
ROWS_PER_RANGE = 4096
LEAST_RANGES = 100
#: Candidates of a query kept in each range, and over all for the exact ranking.
KEEP_RANGE, KEEP_ALL = 10, 60


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of grid cells (rows of ``cells``, each coordinate below 2**bits)."""
    one = np.uint64(1)
    x = [c.astype(np.uint64) for c in cells.T]
    for level in range(bits - 1, 0, -1):  # undo the curve's rotations, coarse levels first
        top, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(x)):
            flip = (x[i] & top) != 0
            swap = (x[0] ^ x[i]) & low
            x0 = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
            x[0] = x0
    for i in range(1, len(x)):  # Gray code across dimensions
        x[i] = x[i] ^ x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix = np.where((x[-1] >> np.uint64(level)) & one != 0, fix ^ ((one << np.uint64(level)) - one), fix)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ fix) >> np.uint64(level)) & one)
    return key


def _frames(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random projection and shift of each ordering; the same for the same dimension."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(ORDERINGS):
        q = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :DIMS]
        out.append((q, rng.uniform(0, 1, size=q.shape[1])))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(ids: np.ndarray, ordering: int) -> np.ndarray:
    """``TIE_BITS`` mixed bits of each id, others in each ordering (SplitMix64)."""
    x = ids.astype(np.uint64) + np.uint64((ordering + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - TIE_BITS)


def _keys(unit: np.ndarray, ids: np.ndarray, frames: list) -> np.ndarray:
    """Curve keys of unit vectors, one column for each ordering; equal cells are spread by the row's id, anew in each ordering."""
    out = []
    for t, (q, shift) in enumerate(frames):
        y = unit @ q * np.sqrt(unit.shape[1])  # about standard normal if the vectors have no direction
        cells = np.clip(((y + 3) / 7 * 2 ** BITS + shift).astype(np.int64), 0, 2 ** BITS - 1)
        out.append((hilbert(cells, BITS) << np.uint64(TIE_BITS)) | _spread(ids, t))
    return np.stack(out, axis=1).view(np.int64)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, vec) of vectors that can be compared, and their dimension.

    Out: null ids; null, empty or zero vectors; null or non-finite components;
    vectors of another dimension than most (the smallest, on ties).
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    rows = rows.where("vec_id is not null and size(vec) > 0").where(
        ~F.exists("vec", bad) & F.exists("vec", lambda v: v != 0))
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return rows, 0
    return rows.where(F.size("vec") == top["d"]), top["d"]


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, k, axis=1)[:, :k]


def _search(batches: Iterator[pa.RecordBatch], dim: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges, sorted by range, a range's candidates before its queries.

    Holds one range's candidates (about ``ROWS_PER_RANGE``) and a block of queries.
    """
    current, ids, units = None, np.empty(0, np.int64), np.empty((0, dim))
    for b in batches:
        where = b.column(0).to_numpy().astype(np.int64) * (1 << 32) + b.column(1).to_numpy()
        is_query, vec = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
        unit = _unit(np.frombuffer(b"".join(b.column(4).to_pylist()), dtype=kind).reshape(-1, dim))
        cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (is_query[1:] != is_query[:-1]), True])
        for s, e in zip(cuts, cuts[1:]):
            if where[s] != current:
                current, ids, units = where[s], np.empty(0, np.int64), np.empty((0, dim))
            if not is_query[s]:
                ids, units = np.r_[ids, vec[s:e]], np.concatenate([units, unit[s:e]])
                continue
            for at in range(s, e, 512):
                q = slice(at, min(at + 512, e))
                if not len(ids):
                    continue
                sims = unit[q] @ units.T
                sims[vec[q][:, None] == ids[None, :]] = -np.inf
                top = _best(sims, KEEP_RANGE)
                near = np.take_along_axis(sims, top, axis=1)
                ok = np.isfinite(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(vec[q], ok.sum(axis=1))), pa.array(ids[top][ok]), pa.array(near[ok])],
                    names=["query_id", "vec_id", "near"])


def nearest(vectors: DataFrame, queries: str, k: int = 5, window: float = WINDOW, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by exact cosine.

    ``queries`` is a condition on ``vec_id`` (SQL); candidates are all rows but
    the query's own id. Rows that repeat an id count once (any of them, by their
    vectors' order). Of equal vectors only the k + 1 smallest ids are
    candidates, as no others can be among the k nearest by the tie rule; each
    still is a query. Fewer than k candidates: all of them.
    """
    if not 0 < k <= KEEP_RANGE:
        raise ValueError(f"k must be from 1 to {KEEP_RANGE}")
    rows, dim = usable(vectors, vec_id, embedding)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    one = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    one = saved(one.select("vec_id", "vec", (nth <= k + 1).alias("found"), F.expr(queries).alias("asks")).where("found or asks"))
    frames = _frames(dim)
    kind = np.float32 if dict(one.dtypes)["vec"] == "array<float>" else np.float64

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind), b.column(0).to_numpy()
            k_ = _keys(_unit(x), ids, frames)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([v.tobytes() for v in x], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, k_.size + 1, k_.shape[1], dtype=np.int32)), pa.array(k_.ravel()))],
                names=["vec_id", "found", "asks", "raw", "keys"])

    coded = saved(one.mapInArrow(keys, "vec_id bigint, found boolean, asks boolean, raw binary, keys array<bigint>"))
    n = coded.where("found").count()
    ranges = min(4096, max(LEAST_RANGES, n // ROWS_PER_RANGE + 1))
    share = max(window if window < 1 else window / max(n, 1), min(1, LEAST_WINDOW / max(n, 1)))
    reach = max(1, int(np.ceil(share * ranges)))
    spread = coded.select("vec_id", "found", "asks", "raw", F.posexplode("keys").alias("ordering", "key"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = {r["ordering"]: sorted(set(r["cuts"])) for r in spread.where("found").groupBy("ordering").agg(
        F.percentile_approx("key", shares, 20 * ranges).alias("cuts")).collect()}  # at most 16 x 4096 numbers
    place = F.lit(0)
    for t, c in cuts.items():
        place = F.when(F.col("ordering") == t, bucket_of(F.col("key"), c)).otherwise(place)
    spread = spread.withColumn("place", place.cast("int"))
    near = F.explode(F.sequence(F.greatest(F.col("place") - reach, F.lit(0)), F.least(F.col("place") + reach, F.lit(ranges - 1))))
    cols = ["ordering", "place", "is_query", "vec_id", "raw"]
    merged = spread.where("found").withColumn("is_query", F.lit(False)).select(cols).unionByName(
        spread.where("asks").withColumn("place", near).withColumn("is_query", F.lit(True)).select(cols))
    hits = (merged.repartition("ordering", "place").sortWithinPartitions("ordering", "place", "is_query")
            .mapInArrow(lambda b: _search(b, dim, kind), "query_id bigint, vec_id bigint, near double"))
    best = hits.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    best = best.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= KEEP_ALL).select("query_id", "vec_id")
    a = one.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qv"))
    b = one.select("vec_id", "vec")
    pairs = best.join(a, "query_id").join(b, "vec_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col("qv"), F.col("vec")
    scored = pairs.select("query_id", "vec_id", (dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(vectors: DataFrame) -> DataFrame:
    """Queries: vec_id divisible by 50."""
    return nearest(vectors, "vec_id % 50 = 0")

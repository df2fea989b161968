"""Embedding whitening by spectrum slicing.

The covariance of the distinct vectors is gathered in Spark (one small matrix
a task, added up by cell). Its leading eigenpairs are found by counting: LDL^T
of the covariance shifted by s has as many negative pivots as there are
eigenvalues below s (Sylvester's law of inertia), so bisection on the counts
isolates the k-th largest eigenvalue. Rayleigh quotient iteration then
converges cubically from inside the isolating interval, and counts just below
and above the result certify that it is the k-th. Eigenvalues that no double
can tell apart share an interval; their vectors are kept orthogonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamwatch.llm.common import fresh, saved

COMPONENTS = 4
SCALE = 256
EPS = float(np.finfo(np.float64).eps)
BUNCH = (1 + 17 ** 0.5) / 8
LONG_MAX = 2 ** 63 - 1


# ---------------------------------------------------------------- small dense matrices

class Shifted:
    """P (A - s I) P^T = L D L^T with symmetric pivoting; D has blocks of one or two rows."""

    def __init__(self, a: np.ndarray, s: float) -> None:
        n = len(a)
        m = a - s * np.eye(n)
        self.order, self.blocks = np.arange(n), []
        tiny = EPS * max(float(np.abs(a).max(initial=0.0)), abs(s), float(np.finfo(np.float64).tiny) / EPS)
        k = 0
        while k < n:
            size = self._pivot(m, k, tiny)
            if size == 1:
                d = m[k, k]
                if abs(d) < tiny:  # an eigenvalue lies on the shift to rounding: either sign counts right
                    d = m[k, k] = tiny if d >= 0 else -tiny
                below = m[k + 1:, k] / d
                m[k + 1:, k + 1:] -= np.outer(below, m[k + 1:, k])
                m[k + 1:, k] = below
            else:
                block = m[k:k + 2, k:k + 2].copy()
                below = np.linalg.solve(block, m[k + 2:, k:k + 2].T).T
                m[k + 2:, k + 2:] -= below @ m[k + 2:, k:k + 2].T
                m[k + 2:, k:k + 2] = below
            self.blocks.append((k, size))
            k += size
        self.m = m

    def _swap(self, m: np.ndarray, i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]

    def _pivot(self, m: np.ndarray, k: int, tiny: float) -> int:
        """Move a good pivot to place k (complete pivoting over what is left); its number of rows."""
        rest = np.abs(m[k:, k:])
        diag = int(np.argmax(np.diagonal(rest)))
        if len(rest) == 1 or rest.max() < tiny:
            return 1
        i, j = np.unravel_index(int(np.argmax(rest)), rest.shape)
        if rest[diag, diag] >= BUNCH * rest[i, j]:
            self._swap(m, k, k + diag)
            return 1
        i, j = sorted((int(i), int(j)))
        self._swap(m, k, k + i)
        self._swap(m, k + 1, k + j)
        return 2

    def below(self) -> int:
        """Eigenvalues below the shift."""
        out = 0
        for k, size in self.blocks:
            if size == 1:
                out += self.m[k, k] < 0
            else:
                a, b, d = self.m[k, k], self.m[k + 1, k], self.m[k + 1, k + 1]
                out += 1 if a * d - b * b < 0 else 2 * (a + d < 0)
        return int(out)

    def solve(self, v: np.ndarray) -> np.ndarray:
        m, x = self.m, v[self.order].astype(np.float64)
        for k, size in self.blocks:
            x[k + size:] -= m[k + size:, k:k + size] @ x[k:k + size]
        for k, size in self.blocks:
            if size == 1:
                x[k] /= m[k, k]
            else:
                block = np.array([[m[k, k], m[k + 1, k]], [m[k + 1, k], m[k + 1, k + 1]]])
                x[k:k + 2] = np.linalg.solve(block, x[k:k + 2])
        for k, size in reversed(self.blocks):
            x[k:k + size] -= m[k + size:, k:k + size].T @ x[k + size:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def above(a: np.ndarray, s: float) -> int:
    """Eigenvalues of ``a`` that are at or above ``s``."""
    return len(a) - Shifted(a, s).below()


def _unit(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in against:
            v = v - (u @ v) * u
        size = float(np.linalg.norm(v))
        if size:
            v = v / size
    return v


def _isolate(a: np.ndarray, k: int, lo: float, hi: float, width: float) -> tuple[float, float, int, int]:
    """(lo, hi, at or above hi, at or above lo): an interval that holds the k-th largest eigenvalue.

    It holds no other one, or is no wider than ``width``.
    """
    n_hi, n_lo = 0, len(a)
    while (n_hi != k - 1 or n_lo != k) and hi - lo > width:
        mid = lo + (hi - lo) / 2
        if not lo < mid < hi:
            break
        n = above(a, mid)
        if n >= k:
            lo, n_lo = mid, n
        else:
            hi, n_hi = mid, n
    return lo, hi, n_hi, n_lo


def leading(a: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive semidefinite matrix, falling, and unit vectors as columns.

    The first entry of largest size of each vector is positive, so equal matrices give equal signs.
    """
    n = len(a)
    a = (a + a.T) / 2
    components = min(components, n)
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    values, vectors = [], []
    if not norm:
        return np.zeros(components), np.eye(n)[:, :components]
    slack = 4 * EPS * norm
    bottom, top = -norm - slack, norm + slack
    for k in range(1, components + 1):
        lo, hi, n_hi, n_lo = _isolate(a, k, bottom, top, slack)
        value = vector = None
        for _ in range(200):
            value, vector, residual = _rayleigh(a, lo, hi, vectors, k)
            margin = max(n * residual, 4 * slack)
            # counts certify the number: at most k - 1 eigenvalues above, at least k from just below
            if lo - margin <= value <= hi + margin and residual <= 64 * slack and above(a, value + margin) <= k - 1 and above(a, value - margin) >= k:
                break
            mid = lo + (hi - lo) / 2
            if hi - lo <= slack or not lo < mid < hi:
                break
            if above(a, mid) >= k:
                lo = mid
            else:
                hi = mid
        values.append(max(value, 0.0))
        vectors.append(vector)
    vectors = [v * np.sign(v[np.argmax(np.abs(v))]) for v in vectors]
    return np.array(values), np.array(vectors).T


def _rayleigh(a: np.ndarray, lo: float, hi: float, found: list[np.ndarray], k: int) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from the middle of an interval: (value, unit vector, residual).

    Steps orthogonal to the vectors found before; the quotient is a shift only while it stays in the interval.
    """
    n = len(a)
    start = np.random.default_rng(k).standard_normal(n)
    v = _unit(start, found)
    shift = lo + (hi - lo) / 2
    best = (0.0, v, float("inf"))
    for step in range(30):
        v = _unit(Shifted(a, shift).solve(v), found)
        value = float(v @ (a @ v))
        residual = float(np.linalg.norm(a @ v - value * v))
        if residual < best[2]:
            best = (value, v, residual)
        elif step > 3:
            break
        if step >= 1 and lo <= value <= hi:
            shift = value
    return best


# ---------------------------------------------------------------- Spark

def whole_vectors(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as long; null if the vector is null or empty or has an entry that is null, not finite or too large."""
    limit = float(2 ** 63)
    scaled = lambda c: F.floor(c.cast("double") * scale)
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < limit))
    return F.when(F.coalesce(fit, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda c: scaled(c).cast("bigint")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _residuals(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly: longs where they fit, else Python's integers."""
    largest = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums.tolist()), default=0)
    if largest <= LONG_MAX:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_residuals(x, n, sums) / n).astype(np.float64)


def _deviations(t: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null where one does not fit a long."""
    if t.dtype != object:
        largest = int(max(abs(int(t.max(initial=0))), abs(int(t.min(initial=0)))))
        if largest * largest * t.shape[1] <= LONG_MAX:
            return np.einsum("ij,ij->i", t, t).tolist()
        t = t.astype(object)
    return [s if s <= LONG_MAX else None for s in (t * t).sum(axis=1).tolist()]


class Fit:
    """What whitening needs: n, exact sums, mean-free covariance, eigenvalues and vectors (all bounded by the dimension)."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int) -> None:
        self.n, self.sums = n, np.array(sums, dtype=object)
        self.trace = float(np.trace(covariance))
        values, vectors = leading(covariance, components)
        floor = 64 * len(covariance) * EPS * self.trace  # below it an eigenvalue is rounding
        self.explained = [float(e) / self.trace if self.trace > 0 else None for e in values]
        self.scaled = [v / np.sqrt(e) if e > floor else None for e, v in zip(values, vectors.T)]


def _totals(fit_list: DataFrame, x: str, d: int) -> tuple[int, list[int]]:
    cells = [F.get(F.col(x), F.lit(i)) for i in range(d)]
    row = fit_list.agg(F.count(F.lit(1)), *[F.try_sum(c) for c in cells]).first()
    if any(s is None for s in row[1:]) and row[0]:  # a sum beyond a long
        row = fit_list.agg(F.count(F.lit(1)), *[F.sum(c.cast("decimal(20,0)")) for c in cells]).first()
    return row[0], [int(s or 0) for s in row[1:]]


def covariance(fit_list: DataFrame, x: str, n: int, sums: list[int]) -> np.ndarray:
    """Sum of outer products of x - S/n over n: a matrix a task, added up by cell in Spark, d * d numbers to the driver."""
    d, exact = len(sums), np.array(sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            c = _centred(_matrix(b.column(0), d), n, exact)
            total += c.T @ c
        upper = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * d + upper[1], pa.int32()), pa.array(total[upper])], names=["cell", "s"])

    out = np.zeros((d, d))
    for r in fit_list.select(x).mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        out[divmod(r["cell"], d)] = r["s"] / n
    return out + np.triu(out, 1).T


def _whitened(rows: DataFrame, keep: list[str], x: str, fit: Fit, d: int, names: tuple[str, str]) -> DataFrame:
    """``keep`` plus the row's deviation and its whitened components (an array, null where the eigenvalue is zero)."""
    n, sums, scaled = fit.n, fit.sums, fit.scaled
    w = np.stack([np.zeros(d) if s is None else s for s in scaled], axis=1)
    void = [s is None for s in scaled]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _residuals(_matrix(b.column(b.num_columns - 1), d), n, sums)
            out = (t / n).astype(np.float64) @ w
            flat = pa.array(out.ravel(), mask=np.tile(np.array(void), len(out)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(void), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_deviations(t), pa.int64()), lists], names=[*keep, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    return rows.select(*keep, x).mapInArrow(run, ", ".join([*kinds, f"{names[0]} bigint", f"{names[1]} array<double>"]))


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           keep: list[str] | None = None) -> DataFrame:
    """A row for each usable row of ``df`` and component: its columns (``keep``, all by default) plus component, n, deviation,
    whitened, explained and identity_error.

    Vectors that are null or empty, or hold an entry that is null, not finite, or
    beyond a long when scaled, take no part; neither do vectors of another length
    than most of the distinct ones have (of equally frequent lengths the longest).
    Entries become floor(scale * c). Statistics are over distinct vectors; copies
    are counted once (a hot vector collapses before the shuffle) and repeated rows
    each get rows. deviation is null if it does not fit a long. Components with an
    eigenvalue of zero (few distinct vectors) have null in whitened and explain
    nothing; explained is null if all vectors are equal. identity_error is measured
    on the whitened fit list, null if no component is left. An empty table gives
    an empty result. Input columns named like the added ones are replaced.
    """
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    (x,) = fresh(df, "_x")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}
    rows = df.select(*keep, whole_vectors(F.col(vector), scale).alias(x)).where(F.col(x).isNotNull())
    distinct = saved(rows.select(x).distinct())
    length = distinct.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        schema = ", ".join([f"`{c}` {k}" for c, k in kinds.items()])
        return df.sparkSession.createDataFrame([], schema + ", component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    d = length["d"]
    fit_list = distinct.where(F.size(x) == d)
    n, sums = _totals(fit_list, x, d)
    fit = Fit(n, sums, covariance(fit_list, x, n, sums), components)
    good = [i for i, s in enumerate(fit.scaled) if s is not None]
    dev, white, error = "_dev", "_white", None
    if good:
        w = _whitened(fit_list.select(x), [], x, fit, d, (dev, white))
        pairs = [(i, j) for i in good for j in good if i <= j]
        found = w.agg(*[F.covar_pop(F.get(white, F.lit(i)), F.get(white, F.lit(j))) for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
    dev, white, position = fresh(df, "_dev", "_white", "_component")
    out = _whitened(rows.where(F.size(x) == d), keep, x, fit, d, (dev, white))
    share = F.array(*[F.lit(e).cast("double") for e in fit.explained])
    out = out.select(*keep, F.col(dev), F.posexplode(white).alias(position, "whitened"))
    return out.select(*keep, (F.col(position) + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), F.col(dev).alias("deviation"),
                      "whitened", F.get(share, F.col(position)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def whitening_report(df: DataFrame) -> DataFrame:
    """Per usable row and component up to four: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(df, keep=["vec_id"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

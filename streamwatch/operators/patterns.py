"""Event patterns per key (C1, C2): the CEP jobs 3.7 and 3.8.

Spark SQL has no MATCH_RECOGNIZE, and the reference uses exactly two pattern
shapes, so each is its own operator:

* ``consecutive``: ``times`` events in a row of one key satisfy ``pred``
  (strict contiguity: no other event of the key in between, in
  (event time, tiebreak) order) and span at most ``within``.
* ``followed_by_within``: every ``first`` event is matched to the earliest
  ``second`` event of its key with ``0 <= second - first <= within``
  (relaxed contiguity); otherwise it times out at ``first + within``. A
  ``second`` with no ``first`` of its key at or before it is reported as
  unmatched.

Both scan in two levels, so a hot key is spread over many tasks and no row is
copied: rows are shuffled once by (key, time bucket) and ordered inside the
bucket only; each bucket is reduced to one summary row; a window over each
key's summaries (bounded by time span / bucket width) tells a bucket what the
buckets around it hold; that is joined back. The bucket width (default one
hour) does not depend on ``within``, and the result is exact for any width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import duration_us, to_us

DEFAULT_BUCKET = "1 hour"


def _as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def _by_bucket(df: DataFrame, keys: list[str], ts: str, bucket) -> DataFrame:
    """Rows in one shuffle by (key, ``_b``); rows and summaries both derive from it."""
    width = max(duration_us(bucket or DEFAULT_BUCKET), 1)
    return df.withColumn("_b", F.floor(to_us(ts) / F.lit(width)).cast("long")).repartition(*keys, "_b")


def _join_back(rows: DataFrame, summaries: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    # null-safe equality infers no not-null filter, so both sides keep the same shuffle underneath
    s = summaries.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_b").alias("_s_b"), *cols)
    cond = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col("_b").eqNullSafe(F.col("_s_b"))]
    return rows.join(s, cond)


def consecutive(df: DataFrame, key, ts: str, pred: Column, times: int = 2, within="2 seconds",
                tiebreak: str | None = None, bucket=None) -> DataFrame:
    """One row per match: key columns, ``first_ts``, ``last_ts`` (and ids when ``tiebreak``).

    Every run of ``times`` adjacent hits alerts, so a run of three hits with
    ``times=2`` gives two alerts. ``within`` is inclusive.
    """
    if times < 1:
        raise ValueError("times must be >= 1")
    keys, ids, more = _as_list(key), _as_list(tiebreak), times - 1
    ev = df.select(*keys, ts, *ids, F.coalesce(pred, F.lit(False)).alias("_hit"))
    fact = F.struct(F.col(ts).alias("t"), F.col("_hit").alias("hit"), *[F.col(i).alias("id") for i in ids])
    if more == 0:
        hits = ev.where("_hit").withColumn("_last", fact)
    else:
        rows = _by_bucket(ev, keys, ts, bucket)
        w = Window.partitionBy(*keys, "_b").orderBy(ts, *ids)
        rows = rows.withColumn("_rn", F.row_number().over(w)).withColumns(
            {f"_f{j}": F.lead(fact, j).over(w) for j in range(1, times)})
        # a match that starts near the end of a bucket goes on with the first rows of the key's next
        # non-empty buckets; each holds a row at least, so `times - 1` of them are enough
        nth = [F.max(F.when(F.col("_rn") == i, fact)) for i in range(1, times)]
        heads = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.array_compact(F.array(*nth)).alias("_heads"))
        ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, more)
        heads = heads.withColumn("_next", F.flatten(F.collect_list("_heads").over(ahead)))
        found = _join_back(rows.where("_hit"), heads, keys, ["_n", "_next"])
        left = F.col("_n") - F.col("_rn")  # rows after this one in its bucket
        nxt = [F.when(left >= j, F.col(f"_f{j}")).otherwise(F.get("_next", (F.lit(j - 1) - left).cast("int")))
               for j in range(1, times)]
        for n in nxt:
            found = found.where(F.coalesce(n["hit"], F.lit(False)))
        hits = found.withColumn("_last", nxt[-1])
    hits = hits.where(to_us(F.col("_last.t")) - to_us(ts) <= F.lit(duration_us(within)))
    return hits.select(*keys, F.col(ts).alias("first_ts"), F.col("_last.t").alias("last_ts"),
                       *[F.col(i).alias(f"first_{i}") for i in ids], *[F.col("_last.id").alias(f"last_{i}") for i in ids])


def followed_by_within(df: DataFrame, key, ts: str, is_first: Column, is_second: Column,
                       within="15 minutes", tiebreak: str | None = None, bucket=None) -> DataFrame:
    """kind in {'matched', 'timeout', 'unmatched_second'} with ``first_ts`` / ``second_ts``.

    Columns: key columns, kind, first_ts, second_ts (null on the side that is
    absent), plus ``first_<tiebreak>`` / ``second_<tiebreak>`` when given. At
    equal times a first precedes a second.
    """
    keys, ids = _as_list(key), _as_list(tiebreak)
    ev = (df.where(is_first | is_second)
            .select(*keys, ts, *ids, F.when(is_first, F.lit(0)).otherwise(F.lit(1)).alias("_k")))
    rows = _by_bucket(ev, keys, ts, bucket)
    second = F.when(F.col("_k") == 1, F.struct(F.col(ts).alias("t"), *[F.col(i).alias("id") for i in ids]))
    growing = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)

    # Per bucket its first second and the time of its first first; over a key's buckets, the first
    # second of a later bucket (scanned backwards, so that frames grow) and whether a first came before.
    of_key = Window.partitionBy(*keys)
    s = rows.groupBy(*keys, "_b").agg(F.min(second).alias("_second"),
                                      F.min(F.when(F.col("_k") == 0, F.col(ts))).alias("_first"))
    s = (s.withColumn("_later", F.last("_second", ignorenulls=True).over(before(of_key.orderBy(F.desc("_b")))))
          .withColumn("_prior", F.coalesce(F.max(F.col("_first").isNotNull()).over(before(of_key.orderBy("_b"))), F.lit(False))))

    desc = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c).desc() for c in [ts, "_k", *ids]])
    rows = rows.withColumn("_in", F.last(second, ignorenulls=True).over(growing(desc)))
    j = _join_back(rows, s, keys, ["_first", "_later", "_prior"])
    j = j.withColumn("_next", F.coalesce("_in", "_later"))
    ok = F.col("_next").isNotNull() & (to_us(F.col("_next.t")) - to_us(ts) <= F.lit(duration_us(within)))
    first = F.col("_k") == 0
    orphan = ~F.col("_prior") & ~F.coalesce(F.col("_first") <= F.col(ts), F.lit(False))
    return j.where(first | orphan).select(
        *keys, F.when(~first, F.lit("unmatched_second")).when(ok, F.lit("matched")).otherwise(F.lit("timeout")).alias("kind"),
        F.when(first, F.col(ts)).alias("first_ts"),
        F.when(~first, F.col(ts)).when(ok, F.col("_next.t")).alias("second_ts"),
        *[F.when(first, F.col(i)).alias(f"first_{i}") for i in ids],
        *[F.when(~first, F.col(i)).when(ok, F.col("_next.id")).alias(f"second_{i}") for i in ids])

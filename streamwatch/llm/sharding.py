"""Sharding (native): contiguous shards of equal bytes, cut from global prefix sums.

Rows are ordered by a key. Quantiles of the key divide the order into parts;
a part is a function of the row, so a task that runs again puts a row in the
same part. Within a part, running sums of bytes and rows need one sorted pass;
the totals of the parts, a bounded table, are summed up over the order, and a
row's place in the whole is its part's total before plus its running sum. A
document lies in the shard in whose share of all bytes its middle falls, so a
shard departs from an equal share by half a document at either end at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamwatch.llm.common import bucket_of, fresh, literal_array, saved

SHARDS = 24
OVERHEAD = 8
#: Rows of a part, and bounds of the number of parts.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 500_000, 64, 10_000


def quantiles(df: DataFrame, order: str, parts: int) -> list[int]:
    """``parts - 1`` values at about equal distances in the order, repeated where one value fills several parts."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(order), shares, 10 * parts)).first()[0]
    return sorted(found or [])


def part_of(order: Column, spread: Column, bounds: list[int]) -> Column:
    """Number of a row's part: rising with ``order`` (nulls first).

    A value that fills several parts (a hot key) is divided by ``spread``, a hash of the row, into as many.
    """
    singles = sorted(set(bounds))
    hot = {b: bounds.count(b) for b in singles if bounds.count(b) > 1} if len(singles) < len(bounds) else {}
    most = max(hot.values(), default=1)
    at = F.when(order.isNull(), F.lit(0)).otherwise(bucket_of(order, singles) + 1).cast("long") * (most + 1)
    if not hot:
        return at
    counts = literal_array([hot.get(b, 0) for b in singles], "bigint")
    slices = F.get(counts, bucket_of(order, singles) - 1)
    is_hot = F.array_contains(literal_array(list(hot), "bigint"), order)
    return F.when(F.coalesce(is_hot, F.lit(False)), at + F.pmod(spread, slices)).otherwise(at + most)


def assign_shards(rows: DataFrame, order: str, size: str, shards: int = SHARDS) -> DataFrame:
    """``rows`` plus shard (0 to ``shards`` - 1), slot (gapless from 0 in each shard) and start (bytes before the row).

    ``order`` is a column of whole numbers, null first; rows with equal values are
    ordered by a hash of the row, so repeated rows each get a slot. ``size`` is a
    column of whole numbers above 0. A row larger than a share can leave shards
    empty. An empty table gives an empty result. Rows travel once, with the columns
    given: leave large ones out and join them back, or use ``write_shards``.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot", "start")]
    part, tie, run, nth, at, ahead, place, first = fresh(rows, "_part", "_tie", "_run", "_nth", "_at", "_ahead", "_place", "_first")
    n = rows.count()
    bounds = quantiles(rows.where(F.col(order).isNotNull()), order, max(LEAST_PARTS, min(MOST_PARTS, n // PART_ROWS)) if n else 1)
    keyed = rows.select(*names, F.xxhash64(*names).alias(tie))
    keyed = keyed.withColumn(part, part_of(F.col(order), F.col(tie), bounds))
    w = Window.partitionBy(part).orderBy(F.col(order).asc_nulls_first(), tie)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = saved(keyed.withColumn(run, F.sum(size).over(upto)).withColumn(nth, F.row_number().over(w)).drop(tie))
    totals = summed.groupBy(F.col(part).alias(at)).agg(F.max(run).alias(run), F.max(nth).alias(nth))  # a row a part
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(at, F.coalesce(F.sum(run).over(before), F.lit(0)).alias(ahead), F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(place))
    whole = totals.agg(F.sum(run)).first()[0] or 1
    placed = summed.join(bases, F.col(part) == F.col(at)).select(
        *names, (F.col(ahead) + F.col(run) - F.col(size)).cast("long").alias("start"), (F.col(place) + F.col(nth) - 1).alias(nth))
    middle = 2 * F.col("start").cast("decimal(20,0)") + F.col(size)
    placed = placed.withColumn("shard", F.floor(middle * shards / F.lit(2 * whole).cast("decimal(20,0)")).cast("int"))
    firsts = placed.groupBy(F.col("shard").alias(at)).agg(F.min(nth).alias(first))  # a row a shard
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col(at)).select(
        *names, "shard", (F.col(nth) - F.col(first)).cast("long").alias("slot"), "start")


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Bytes of the text in UTF-8 (null: none) and the overhead of a record."""
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + OVERHEAD).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with their texts, plus size, shard, slot and start. Input columns with these names are replaced."""
    kept = docs.select([c for c in docs.columns if c.lower() not in ("size", "shard", "slot", "start")])
    return assign_shards(kept.withColumn("size", sizes(docs, text)), key, "size", shards)


def write_shards(sharded: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder a shard, each written by as many tasks as its rows need, in slot order within a file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("error").format(fmt).save(path)


def sharding_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not a law by key), start.

    A null text has the crc32 of an empty one.
    """
    rows = docs.select("doc_id", sizes(docs).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return assign_shards(rows, "doc_id", "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start")


#: The same rows in DuckDB: one running sum over all documents, CRC-32 byte by byte.
OP_SQL = """
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
         UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, strlen(text)::BIGINT + 8 AS size, xor(list_reduce(
             list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, crc),
p AS (SELECT *, (sum(size) OVER (ORDER BY doc_id))::BIGINT - size AS start, (sum(size) OVER ())::BIGINT AS whole FROM s),
a AS (SELECT doc_id, size, text_crc32, (((2 * start + size) * 24) // (2 * whole))::INTEGER AS shard, start FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, start FROM a"""

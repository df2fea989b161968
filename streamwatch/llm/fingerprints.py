"""Document fingerprints (native): SimHash over weighted term hashes, searched by permuted block tables.

A text's terms are its lower-cased words. Each occurrence votes with its weight
on 64 signed bits; a bit is set if its votes sum to more than zero. The weight
grows with the square of a word's length (1 to ``MAX_WEIGHT``): long words are
rare, short ones are shared by unrelated texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamwatch.llm.common import bucket_of

WORD_GAP = r"[\x20\x09-\x0D]+"
MAX_WEIGHT = 64
LOW = 0xFFFFFFFF
BIT_PAIR = 0x0000000100000001
ROWS_PER_BUCKET = 256
MAX_BUCKETS = 65536


def weight(term: Column) -> Column:
    """Vote of one occurrence of a term; none for an empty one."""
    n = F.least(F.length(term), F.lit(16))
    return F.when(n > 0, F.greatest(F.lit(1), F.shiftright(n * n, 2))).otherwise(0).cast("long")


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., fp): the fingerprint of each key's text, as a long.

    ``keys`` identify a row. Counters of two bits share one long, 32 bits each,
    so a document may hold 67 million words. Partial sums form before the
    shuffle: one row of counters for each document and task. Texts without
    words, null ones included, get fingerprint zero; no row is lost.
    """
    rows = texts.select(*keys, F.explode_outer(F.split(F.lower(F.col(text)), WORD_GAP, -1)).alias("term"))
    hashed = rows.select(*keys, F.coalesce(weight(F.col("term")), F.lit(0)).alias("w"), F.xxhash64("term").alias("h"))
    sums = [F.sum(F.col("w") * F.shiftright("h", i).bitwiseAND(F.lit(BIT_PAIR))).alias(f"s{i}") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    out = F.lit(0).cast("long")
    for i in range(32):
        for bit, n in ((i, F.col(f"s{i}").bitwiseAND(F.lit(LOW))), (i + 32, F.shiftrightunsigned(F.col(f"s{i}"), 32))):
            one = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(2 * n > F.col("total"), one).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, out.alias("fp"))


def fingerprint_string(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return (64 - distance(a, b)) / F.lit(64.0)


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp, bits): all distinct corpus fingerprints within ``radius`` bits of each distinct query.

    Permuted block tables: the 64 bits are cut into radius + 1 blocks; two
    fingerprints within the radius agree on one block at least, so each block's
    table is joined on its value and the distance is verified. Fingerprints are
    made distinct first: copies do not multiply the pairs. ``queries`` and
    ``corpus`` have a column fp; nulls take no part.
    """
    if not 0 <= radius < 32:
        raise ValueError("radius must be from 0 to 31")
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        values = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks]
        return (df.select("fp").where("fp is not null").distinct()
                .select(F.col("fp").alias(name), F.posexplode(F.array(*values)).alias("block", "value")))

    pairs = blocks(queries, "query").join(blocks(corpus, "fp"), ["block", "value"])
    return (pairs.select("query", "fp", distance(F.col("query"), F.col("fp")).alias("bits"))
            .where(F.col("bits") <= radius).distinct())


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, rn, doc_id, text, next_bucket, next_rn, next_text): documents with their successor by doc_id.

    Rows order by (doc_id, text), nulls first; after the last comes the first.
    Buckets of consecutive ids (cut at approximate percentiles) order in
    parallel, so texts are shuffled once; only one row for each bucket (at most
    ``MAX_BUCKETS``) goes through the step that links buckets.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if buckets is None:
        buckets = min(MAX_BUCKETS, docs.count() // ROWS_PER_BUCKET + 1)
    cuts = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets + 10000)).first()[0] or []
        cuts = sorted(set(cuts))
    w = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "text")
    rows = (docs.withColumn("bucket", F.coalesce(bucket_of(F.col("doc_id"), cuts), F.lit(0)))
            .select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("after")))
    heads = rows.where("rn = 1").select(F.col("bucket").alias("head_bucket"), F.col("text").alias("head_text"))
    over = Window.partitionBy(F.lit(0)).orderBy("b")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (docs.select(F.coalesce(bucket_of(F.col("doc_id"), cuts), F.lit(0)).alias("b")).distinct()
            .select("b", F.coalesce(F.lead("b").over(over), F.min("b").over(whole)).alias("next_b")))
    tails = turn.join(heads, F.col("next_b") == F.col("head_bucket")).select("b", "next_b", "head_text")
    last = F.col("after").isNull()
    return rows.join(tails, F.col("bucket") == F.col("b")).select(
        "bucket", "rn", "doc_id", "text",
        F.when(last, F.col("next_b")).otherwise(F.col("bucket")).alias("next_bucket"),
        F.when(last, F.lit(1)).otherwise(F.col("rn") + 1).alias("next_rn"),
        F.when(last, F.col("head_text")).otherwise(F.col("after")).alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: fingerprints of its text and of its edited text, and their likeness.

    Repeated rows each get a row and follow one another; null text counts as
    empty; null doc_id comes first. One document alone is its own successor.
    """
    rows = with_next(docs)
    both = F.explode(F.array(
        F.struct(F.lit(0).alias("edited"), F.col("text")),
        F.struct(F.lit(1).alias("edited"), edited_text(F.col("text"), F.col("next_text")).alias("text"))))
    facts = ["doc_id", "next_bucket", "next_rn", "n_chars", "sha"]
    versions = rows.select("bucket", "rn", "doc_id", "next_bucket", "next_rn", F.length("text").cast("long").alias("n_chars"),
                           both.alias("v")).select("*", "v.edited", "v.text", F.sha2("v.text", 256).alias("sha"))
    prints = simhash(versions, ["bucket", "rn", "edited", *facts], "text")
    pick = lambda c, e: F.max(F.when(F.col("edited") == e, F.col(c)))
    one = prints.groupBy("bucket", "rn").agg(
        *[F.max(c).alias(c) for c in facts[:4]], pick("sha", 1).alias("edited_sha256"),
        pick("fp", 0).alias("fp"), pick("fp", 1).alias("efp"))
    other = one.select(F.col("bucket").alias("ob"), F.col("rn").alias("orn"), F.col("fp").alias("ofp"))
    c = F.col
    return one.join(other, (c("next_bucket") == c("ob")) & (c("next_rn") == c("orn"))).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_string(c("fp")).alias("fingerprint"),
        fingerprint_string(c("efp")).alias("edited_fingerprint"),
        likeness(c("fp"), c("efp")).alias("near_edited"), likeness(c("fp"), c("ofp")).alias("near_next"))

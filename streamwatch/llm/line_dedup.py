"""Line dedup by site-relative frequency (native).

A line is boilerplate of a host if the share of the host's pages that contain
it is above ``ratio`` (and at least ``min_pages`` pages do). Lines are compared
without surrounding blanks; blank lines are never counted and never dropped.
Pages are rows, or with ``by_text`` the different texts of a host, so that
copies of a page do not make its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamwatch.llm.common import fresh, saved

RATIO = 0.1
MIN_PAGES = 3
BLANKS = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _page_texts(src: DataFrame) -> DataFrame:
    """(host, keys): one row for each different set of lines of a host; travels as keys, copies meet before the shuffle."""
    line = F.array_distinct(F.transform(F.split("text", "\n", -1), _trimmed))
    keys = F.array_sort(F.transform(F.filter(line, lambda x: x != ""), _key))
    return (src.select("host", keys.alias("keys"))
            .select("host", F.xxhash64("keys").alias("a"), F.xxhash64("keys", F.lit(1)).alias("b"), "keys")
            .dropDuplicates(["host", "a", "b"]).select("host", "keys"))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                      host: str = "source", text: str = "text", by_text: bool = False) -> DataFrame:
    """(host, lines): per host the keys of its boilerplate lines.

    A page counts a line once. With ``by_text`` pages of a host with the same set
    of lines (blanks aside) count as one page, in the line's count and in the total.
    Lines above the ratio number at most (mean lines per page) / ratio on a host,
    so the array is bounded whatever the host's size. A host without boilerplate
    has no row; null is a host like any other.
    """
    src = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    if by_text:
        src = saved(_page_texts(src))
        keys = src.select("host", F.explode("keys").alias("key"))
    else:
        line = F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), _trimmed)))
        keys = src.select("host", line.alias("line")).where("line <> ''").select("host", _key(F.col("line")).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("n"))
    totals = src.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("total"))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("site")))
            .where((F.col("n") >= min_pages) & (F.col("n") / F.col("total") > F.lit(float(ratio))))
            .groupBy("host").agg(F.collect_list("key").alias("lines")))


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                    host: str = "source", text: str = "text", by_text: bool = False) -> DataFrame:
    """``pages`` without boilerplate lines, plus ``n_lines`` and ``n_dropped``.

    One output row per input row, repeated rows included; other columns are kept
    (an input column called n_lines or n_dropped is replaced). Null text: null
    text, 0 lines. An empty table gives an empty table.
    """
    out_cols = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    pages = pages.select(out_cols)
    site, lines, split, kept = fresh(pages, "site", "lines", "split", "kept")
    drop = boilerplate_lines(pages, ratio, min_pages, host, text, by_text).toDF(site, lines)
    joined = pages.join(drop, pages[host].eqNullSafe(drop[site]), "left")
    joined = joined.withColumn(split, F.split(F.col(text), "\n", -1))
    is_dropped = lambda x: F.array_contains(F.col(lines), _key(_trimmed(x)))
    joined = joined.withColumn(kept, F.when(F.col(lines).isNull(), F.col(split)).otherwise(
        F.filter(F.col(split), lambda x: ~is_dropped(x))))
    n = F.coalesce(F.size(split), F.lit(0))
    n_kept = F.coalesce(F.size(kept), F.lit(0))
    n, n_kept = (F.greatest(x, F.lit(0)).cast("long") for x in (n, n_kept))
    return joined.select(
        *[F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in out_cols],
        n.alias("n_lines"), (n - n_kept).alias("n_dropped"))


OP_SQL = f"""
WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM p),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT c.source, list(line) AS bl FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE n >= {MIN_PAGES} AND CAST(n AS DOUBLE) / total > CAST({RATIO} AS DOUBLE) GROUP BY c.source),
k AS (SELECT p.doc_id, p.ls, CASE WHEN b.bl IS NULL THEN p.ls ELSE
        list_filter(p.ls, lambda x: NOT list_contains(b.bl, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
      FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN ls IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""

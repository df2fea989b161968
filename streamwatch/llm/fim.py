"""Fill-in-middle transformation over a Roaring-style set of unit boundaries.

A text is cut into units (runs of letters A-Z, a-z, and single other code
points). The offsets at which units end form a boundary set: per 65,536 code
points one container, of the kind that takes the least room (sorted array,
bitmap, or runs), with the cumulative cardinalities of the containers before
it. The offset after k units is ``select(k - 1)``: a search over the cumulative
cardinalities finds the container, a local select the place in it. Both cuts of
a text come from its set, so finding them costs the same wherever they lie.

Python builds the sets (Arrow batches of whole texts) and returns two offsets
a row; the texts are rearranged and rebuilt by Spark's own functions.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamwatch.llm.common import fresh

# Fixed values of the output format and of the draws.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED_PERCENT, SPM_PERCENT = 90, 20
SEED = "1"

CHUNK = 1 << 16
CUTS = "n bigint, first bigint, second bigint"


class ArrayContainer:
    """Sorted offsets, two bytes each."""

    def __init__(self, mask: np.ndarray) -> None:
        self.values = np.flatnonzero(mask).astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.values[i])

    def rank(self, low: int) -> int:
        """Members at or below ``low``."""
        return int(np.searchsorted(self.values, low, side="right"))


class BitmapContainer:
    """One bit an offset in 64-bit words, with the number of bits before each word."""

    def __init__(self, mask: np.ndarray) -> None:
        padded = np.zeros(-(-len(mask) // 64) * 64, dtype=bool)
        padded[:len(mask)] = mask
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def _bits(self, word: int) -> np.ndarray:
        return np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        return 64 * word + int(np.flatnonzero(self._bits(word))[i - int(self.before[word])])

    def rank(self, low: int) -> int:
        word, bit = divmod(low, 64)
        if word >= len(self.words):
            return int(self.before[-1])
        return int(self.before[word]) + int(self._bits(word)[:bit + 1].sum())


class RunContainer:
    """First offsets of runs, with the number of members before each run."""

    def __init__(self, mask: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        self.starts = edges[::2].astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2], dtype=np.int64)])

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])

    def rank(self, low: int) -> int:
        run = int(np.searchsorted(self.starts, low, side="right")) - 1
        return 0 if run < 0 else int(self.before[run]) + min(low - int(self.starts[run]) + 1, int(self.before[run + 1] - self.before[run]))


class BoundarySet:
    """Compressed set of offsets, from a mask of its members."""

    def __init__(self, mask: np.ndarray) -> None:
        self.keys: list[int] = []
        self.containers: list = []
        self.before = [0]
        for key, at in enumerate(range(0, len(mask), CHUNK)):
            part = mask[at:at + CHUNK]
            n = int(np.count_nonzero(part))
            if n:
                runs = int(np.count_nonzero(part[1:] & ~part[:-1])) + int(part[0])
                room = {ArrayContainer: 2 * n, RunContainer: 4 * runs, BitmapContainer: CHUNK // 8}
                self.keys.append(key)
                self.containers.append(min(room, key=room.get)(part))
                self.before.append(self.before[-1] + n)

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, i: int) -> int:
        """The i-th smallest member, from 0."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        c = bisect.bisect_right(self.before, i) - 1
        return self.keys[c] * CHUNK + self.containers[c].select(i - self.before[c])

    def rank(self, offset: int) -> int:
        """Members at or below ``offset``."""
        key, low = divmod(offset, CHUNK)
        c = bisect.bisect_left(self.keys, key)
        here = c < len(self.keys) and self.keys[c] == key
        return self.before[c] + (self.containers[c].rank(low) if here else 0)


def unit_ends(text: str) -> np.ndarray:
    """Mask over offsets 0 to the length (code points): whether a unit ends there."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = (points | 32) - 97 < 26  # unsigned: below "a" wraps to large numbers
    out = np.ones(len(points) + 1, dtype=bool)
    out[0] = False
    out[1:-1] = ~(letter[:-1] & letter[1:])
    return out


def boundaries(text: str) -> BoundarySet:
    return BoundarySet(unit_ends(text))


def cut_offsets(ends: BoundarySet, a: int, b: int) -> tuple[int, int]:
    """Code points before the cuts after ``a`` and after ``b`` units."""
    return tuple(ends.select(k - 1) if k else 0 for k in (a, b))


def cuts(text: Column, h1: Column, h2: Column) -> Column:
    """Struct (n, first, second): units of a text, and the code points before either cut.

    The cuts lie after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units.
    """
    @F.pandas_udf(CUTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in batches:
            out = np.zeros((len(texts), 3), dtype=np.int64)
            for i, (t, x, y) in enumerate(zip(texts, one, two)):
                ends = boundaries(t)
                n = len(ends)
                out[i] = n, *cut_offsets(ends, *sorted((x % (n + 1), y % (n + 1))))
            yield pd.DataFrame(out, columns=["n", "first", "second"])

    return run(text, h1, h2)


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32: the first groups of eight digits of the sha256 of ``seed:key`` (null key: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = SEED,
                   transformed: int = TRANSFORMED_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``docs`` plus n, form, prefix_chars, middle_chars and output.

    n: units of the text. form: ``plain`` (output is the text) for ``100 -
    transformed`` percent of keys and wherever the text is empty or holds one of
    the three marks; of the others ``spm`` percent get ``spm``, the rest ``psm``.
    prefix_chars and middle_chars are code points, null if plain. A null text counts
    as empty, a null key as an empty one; the draws depend on the key alone, so
    repeated rows get equal results, a row each. Input columns with these names
    are replaced.
    """
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c.lower() not in names]
    t, h1, h2, h3, h4, c = fresh(docs, "_text", "_h1", "_h2", "_h3", "_h4", "_cuts")
    rows = docs.select("*", F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t), *[
        d.alias(n) for d, n in zip(draws(F.col(key), seed), (h1, h2, h3, h4))])
    rows = rows.select(*kept, t, h3, h4, cuts(F.col(t), F.col(h1), F.col(h2)).alias(c))
    body, first, second = F.col(t), F.col(f"{c}.first"), F.col(f"{c}.second")
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | body.contains(m)
    plain = (body == "") | marked | (F.col(h3) % 100 >= transformed)
    form = F.when(plain, "plain").when(F.col(h4) % 100 < spm, "spm").otherwise("psm")
    p = F.substring(body, F.lit(1), first.cast("int"))
    m = F.substring(body, (first + 1).cast("int"), (second - first).cast("int"))
    s = F.substring(body, (second + 1).cast("int"), F.lit(2147483647))
    rows = rows.withColumn("form", form)
    output = (F.when(F.col("form") == "plain", body)
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
              .otherwise(F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)))
    chars = lambda x: F.when(F.col("form") != "plain", x)
    return rows.select(*kept, F.col(f"{c}.n").alias("n"), "form", chars(first).alias("prefix_chars"),
                       chars(second - first).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    A transformed text holds none of the marks and no mark can begin in the text
    and end in a mark, so each mark occurs once and cuts the output in three.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    prefix, suffix, middle = F.get(parts, F.when(form == "spm", 2).otherwise(1)), F.get(parts, F.when(form == "spm", 1).otherwise(2)), F.get(parts, F.lit(3))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def fim_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it.

    An empty table gives an empty result; null texts count as empty.
    """
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same rows in DuckDB, by lists of units.
OP_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""

"""Substring dedup by seed and extend: words covered by a 20-word passage that occurs earlier are removed.

Seeds: every window of ``WINDOW`` words has one anchor, the least hash among its
``SEED``-word runs (winnowing), so equal windows have equal anchors. Anchors are
counted over all documents; one that occurs once cannot lie in a repeat.

Extension, both ways: an anchor is extended to the stretch of all windows that it
anchors. Occurrences with equal stretches repeat as a whole: the first stays, in
the others all windows are repeats. Only where occurrences of an anchor differ
somewhere are the windows of the distinct stretches compared one by one.
Adjoining repeated windows merge into maximal repeats when words are removed.

Comparisons are by 96-bit hash and need no pairs. An anchor with many
occurrences is dealt into slices by document: first within a slice, then over
the slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamwatch.llm.common import one_row_per_key, saved

WINDOW = 20
SEED = 6
#: Occurrences of an anchor that one slice holds.
SLICE = 4096
MOST_WORDS_KNOWN = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values (splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Words to 64-bit values; what it remembers is bounded."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        if len(known) > MOST_WORDS_KNOWN:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


class Spans:
    """Hashes of any spans of a sequence of values, equal for equal spans wherever they start."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        powers = np.full(len(values) + 1, base, dtype=np.uint64)
        powers[0] = 1
        inverse = np.full(len(values) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.back = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(powers, dtype=np.uint64)[:-1], dtype=np.uint64)])

    def __call__(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[starts + sizes] - self.sums[starts]) * self.back[starts] + np.asarray(sizes).astype(np.uint64))


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def anchors(values: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds, and for each window the position of its anchor (the leftmost least seed)."""
    seeds = Spans(values, BASES[0])(np.arange(len(values) - seed + 1), seed)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)
    return seeds, view.argmin(axis=1) + np.arange(len(view))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # for bytes: at space and 0x09 to 0x0D


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def _lists(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a column of arrays of structs."""
    col = batch.column(i)
    return col.offsets.to_numpy(), [f.to_numpy(zero_copy_only=False) for f in col.values.flatten()]


def _rows(batch: pa.RecordBatch, at: list[int], parts: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One record batch from per-document arrays; the first column repeats the document's id."""
    if at:
        ids = np.repeat(at, [len(p[0]) for p in parts])
        cols = [np.concatenate(c) for c in zip(*parts)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *map(pa.array, cols)], names=names)


def _two_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    a = Spans(values, BASES[0])(starts, sizes).view(np.int64)
    b = Spans(_mix(values), BASES[1])(starts, sizes) >> np.uint64(32)
    return a, b.astype(np.uint32).view(np.int32)


def _seeds(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        ids, found = [], []
        for i, t in enumerate(_texts(b, 1)):
            words = words_of(t)
            if len(words) >= window:
                s, at = anchors(hashes(words), window, seed)
                ids.append(i)
                found.append(s[np.unique(at)].view(np.int64))
        if ids:
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), lists], names=["doc_id", "seeds"])


def _stretches(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n, times, h1, h2): the stretch of n windows of each repeated anchor."""
    hashes = WordHashes()
    for b in batches:
        ends, (known, times) = _lists(b, 2)
        ids, parts = [], []
        for i, t in enumerate(_texts(b, 1)):
            mine, n_times = known[ends[i]:ends[i + 1]], times[ends[i]:ends[i + 1]]
            order = np.argsort(mine)
            mine, n_times = mine[order], n_times[order]
            values = hashes(words_of(t))
            s, at = anchors(values, window, seed)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sizes = np.diff(np.r_[first, len(at)])
            own = s[at[first]].view(np.int64)
            place = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
            ok = mine[place] == own
            first, sizes = first[ok], sizes[ok]
            ids.append(i)
            parts.append((first.astype(np.int32), sizes.astype(np.int32), n_times[place[ok]], *_two_hashes(values, first, sizes + window - 1)))
        yield from _rows(b, ids, parts, ["doc_id", "start", "n", "times", "h1", "h2"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n = 1, times, h1, h2): the windows of the listed stretches."""
    hashes = WordHashes()
    for b in batches:
        ends, (starts, sizes, times) = _lists(b, 2)
        ids, parts = [], []
        for i, t in enumerate(_texts(b, 1)):
            s, n, k = (x[ends[i]:ends[i + 1]] for x in (starts, sizes, times))
            each = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            ids.append(i)
            parts.append((each.astype(np.int32), np.ones(len(each), np.int32), np.repeat(k, n), *_two_hashes(hashes(words_of(t)), each, window)))
        yield from _rows(b, ids, parts, ["doc_id", "start", "n", "times", "h1", "h2"])


def _split_first(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(later, first) rows of each (h1, h2) by doc_id and start; ``first`` has ``same``, the rows with its hash.

    Rows whose anchor occurs more than ``SLICE`` times are ordered within slices
    of their documents before the slices' first rows meet; ``same`` is 0 there.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("start")]
    slices = F.ceil(F.col("times") / SLICE).cast("int")
    rows = rows.withColumn("slice", F.when(slices > 1, F.pmod(F.xxhash64("doc_id"), slices)).otherwise(0).cast("int"))
    w = Window.partitionBy("h1", "h2", "slice")
    rows = rows.select("*", F.lag("start").over(w.orderBy(*order)).alias("before"),
                       F.when(slices == 1, F.count("*").over(w)).otherwise(0).cast("long").alias("same"))
    cols = ["doc_id", "start", "n", "times", "same"]
    hot = rows.where((F.col("before").isNull()) & (slices > 1)).drop("before")
    hot = hot.withColumn("before", F.lag("start").over(Window.partitionBy("h1", "h2").orderBy(*order)))
    # `times` is read in every branch, so that all share one shuffle of `rows`.
    later = rows.where("before is not null and times > 1").select(cols).unionByName(hot.where("before is not null").select(cols))
    first = rows.where(F.col("before").isNull() & (slices == 1)).select(cols).unionByName(hot.where("before is null").select(cols))
    return later, first


def repeated_stretches(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, start, n): runs of n windows whose words all also start earlier.

    ``docs`` has one row for each doc_id, null being the smallest id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, start int, n int, times bigint, h1 bigint, h2 int"
    docs = docs.select("doc_id", "text")

    def with_lists(rows: DataFrame, *fields: str) -> DataFrame:
        lists = rows.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct(*fields)).alias("list"))
        return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text", "list")

    found = saved(docs.mapInArrow(lambda b: _seeds(b, window, seed), f"doc_id {kind}, seeds array<bigint>"))
    found = found.select("doc_id", F.explode("seeds").alias("seed"))
    # Saved, so that both sides of the join are shuffles that can be split at hot seeds.
    repeated = saved(found.groupBy(F.col("seed").alias("again")).agg(F.count("*").alias("times")).where("times > 1"))
    mine = found.join(repeated, F.col("seed") == F.col("again")).select("doc_id", "seed", "times")
    stretches = with_lists(mine, "seed", "times").mapInArrow(lambda b: _stretches(b, window, seed), columns)
    later, first = _split_first(stretches)
    # An anchor all of whose occurrences have this stretch has no other windows to compare.
    open_ = first.where("same < times").select("doc_id", "start", "n", "times")
    single = with_lists(open_, "start", "n", "times").mapInArrow(lambda b: _windows(b, window), columns)
    return later.select("doc_id", "start", "n").unionByName(_split_first(single)[0].select("doc_id", "start", "n"))


def _report(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        totals, removed, kept = [], [], []
        for t, starts in zip(_texts(b, 1), b.column(2)):
            words = words_of(t)
            totals.append(len(words))
            if starts.is_valid:
                s, n = (f.to_numpy(zero_copy_only=False) for f in starts.values.flatten())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n - 1 + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                words = [w for w, k in zip(words, stay.tolist()) if k]
            removed.append(totals[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space.

    A word goes if a window of ``window`` words that covers it has the same words
    as one that starts earlier (smaller doc_id, or earlier in the same document).
    Windows are judged on the input. Null text: no words. Rows that share a
    doc_id count as one document, their smallest text; a null doc_id is the
    smallest id. Texts shorter than the window are kept whole.
    """
    if not 0 < seed <= window:
        raise ValueError("seed must be from 1 to window")
    docs = one_row_per_key(docs.select("doc_id", "text"), "doc_id", "text")
    found = repeated_stretches(docs, window, seed).groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_list(F.struct("start", "n")).alias("starts"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(lambda b: _report(b, window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def drop_repeats_report(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

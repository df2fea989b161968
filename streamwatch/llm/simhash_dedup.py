"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in three bits or fewer have a common
variant: one flips one bit or none, the other two or fewer. Of any three
differing bits two lie in the same 32-bit half, and one of two fingerprints at
an odd distance has even parity. So it is enough that every fingerprint emits
itself and its 64 one-flip variants, and that one of even parity also emits its
992 two-flip variants within a half.

Variants are shuffled by their value at 24 key bits. All variants of a
fingerprint that share that value travel as one row and are spelled out in the
task that receives them: about 91 rows for 561 variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwatch.llm.common import fresh, release_memory, saved
from streamwatch.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
KEY_BITS = [*range(12), *range(32, 44)]
FREE_BITS = [b for b in range(64) if b not in KEY_BITS]
KEY_MASK = sum(1 << b for b in KEY_BITS)
#: Variants that a task spells out at once.
BLOCK = 2_000_000


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(bits: list[int]) -> list[int]:
    return [1 << a | 1 << b for a, b in combinations(bits, 2) if a // 32 == b // 32]


def simhash64(text: bytes | None) -> int:
    """Fingerprint of a UTF-8 text: bit i is set if it is set in over half the shingles' XXH64 values."""
    words = (text or b"").translate(LOWER).split()  # splits at space and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per input row; texts that are null or have no word get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(simhash64(t.as_py())) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])
        release_memory()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


def balls(fps: DataFrame) -> DataFrame:
    """(key, fp): for each fingerprint the values at the key bits that its variants take."""
    one = [0] + [1 << b for b in KEY_BITS]
    masks = lambda m: F.array(*[F.lit(signed(x)) for x in m])
    flips = F.when(F.bit_count("fp") % 2 == 0, masks(one + _pairs(KEY_BITS))).otherwise(masks(one))
    return fps.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(signed(KEY_MASK))).alias("key"), "fp")


def _variants(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All variants that the rows stand for: value, row, number of flips; fewer flips first."""
    diff = (fps ^ keys) & np.uint64(KEY_MASK)
    done = np.bitwise_count(diff)
    even = np.bitwise_count(fps) % 2 == 0
    moved = fps ^ diff
    single = [1 << b for b in FREE_BITS]
    halves = [np.array([m for m in single if (m >> 32 != 0) == h], dtype=np.uint64) for h in (False, True)]
    high = (diff >> np.uint64(32)) != 0
    plan = [(done == 0, 1, np.array(single, dtype=np.uint64)),
            ((done == 0) & even, 2, np.array(_pairs(FREE_BITS), dtype=np.uint64))]
    plan += [((done == 1) & even & (high == h), 2, halves[h]) for h in (False, True)]
    values, rows, flips = [moved], [np.arange(len(fps))], [done.astype(np.uint8)]
    for where, n, masks in plan:
        at = np.flatnonzero(where)
        values.append((moved[at][:, None] ^ masks[None, :]).ravel())
        rows.append(np.repeat(at, len(masks)))
        flips.append(np.full(len(at) * len(masks), n, dtype=np.uint8))
    return np.concatenate(values), np.concatenate(rows), np.concatenate(flips)


def _meet(fps: np.ndarray, values: np.ndarray, rows: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant: all that do link to one that flips one bit or none."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(len(v), dtype=bool)
    same[1:] = v[1:] == v[:-1]
    keep = same.copy()
    keep[:-1] |= same[1:]
    order, v, same = order[keep], v[keep], same[keep]
    if not len(v):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    by = np.lexsort((flips[order], v))  # the one with the fewest flips leads its variant
    order = order[by]
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))
    a, b = fps[rows[order[lead]]], fps[rows[order]]
    ok = same & (flips[order[lead]] <= 1) & (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    return a[ok], b[ok]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as the links a-b with at most one link for each node: to the least one it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _link_rows(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that hold all fingerprints of each of their keys.

    A key with very many fingerprints is taken in several passes, each over the
    variants with one value at some free bits, so memory stays bounded.
    """
    passes = 1
    if keys[0] == keys[-1]:
        while len(fps) * 256 > BLOCK * passes and passes < 4096:
            passes *= 2
    if passes == 1:
        return _meet(fps, *_variants(keys, fps))
    shift, found = np.uint64(FREE_BITS[0]), []
    step = max(1, BLOCK // 1024)
    for p in range(passes):
        parts = []
        for at in range(0, len(fps), step):
            v, r, f = _variants(keys[at:at + step], fps[at:at + step])
            mine = ((v >> shift) & np.uint64(passes - 1)) == np.uint64(p)
            parts.append((v[mine], r[mine] + at, f[mine]))
        found.append(_meet(fps, *(np.concatenate(x) for x in zip(*parts))))
    return tuple(np.concatenate(x) for x in zip(*found))


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key; whole keys are taken together."""
    most = BLOCK // 8
    keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _link_rows(k, f)
        if len(a):
            a, b = _stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    def cut(k: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of about ``most`` rows or fewer, or of one key."""
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        at = n = 0
        for s, size in zip(starts.tolist(), sizes.tolist()):
            if n and n + size > most:
                yield k[at:s], f[at:s]
                at, n = s, 0
            n += size
        yield k[at:], f[at:]

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy().view(np.uint64)])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) >= most and keys[0] != keys[-1]:
            end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            for k, f in cut(keys[:end], fps[:end]):
                yield from out(k, f)
            keys, fps = keys[end:], fps[end:]
    if len(keys):
        for k, f in cut(keys, fps):
            yield from out(k, f)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all pairs within three bits.

    Not every pair is listed; its two sides are always connected through links,
    each of which joins fingerprints that are themselves so connected.
    """
    rows = balls(fps)
    return (rows.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_link_batches, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): one row per input row; component_id is the smallest key reachable.

    Fingerprints at three or fewer differing bits link, that of wordless and
    null texts (zero) like any other. Repeated rows count as one node; a null
    key is kept and never is a component's smallest unless there is no other.
    Only distinct fingerprints take part in the search, so copies cost nothing
    beyond their own rows. An empty table gives an empty table.
    """
    prints = saved(fingerprints(docs, key, text))
    nodes = saved(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = connected_components(links(nodes.select("fp")))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = saved(labelled)
    ids = labelled.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    classes = saved(labelled.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("cfp"), "component_id"))
    return prints.join(classes, F.col("fp") == F.col("cfp")).select(F.col("key").alias(key), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the smallest key (one row of it).

    Documents with a null key stay if nothing else is in their group. Columns are kept.
    """
    found = near_duplicates(docs, key, text)
    heads = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(key).agg(F.count("*").alias("rows"))
    heads = saved(heads)
    k, n = fresh(docs, "head_key", "rows")
    heads_ = heads.toDF(k, n)
    kept = docs.join(heads_.select(k), docs[key].eqNullSafe(F.col(k)), "left_semi")
    if heads.where(F.col("rows") > 1).isEmpty():
        return kept
    others = [c for c in docs.columns if c != key]
    return kept.groupBy(key).agg(F.min(F.struct(*others)).alias(k)).select(*[F.col(key) if c == key else F.col(k)[c].alias(c) for c in docs.columns])


def near_duplicates_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs.select("doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

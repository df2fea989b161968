"""Best-fit packing by a plan over the histogram of piece lengths.

Documents are tokenized and cut into pieces of at most ``LIMIT`` tokens. Only
the number of pieces of each length (at most ``LIMIT`` numbers) comes to the
driver, which runs best-fit decreasing over counts: sequences with equal
contents so far are one group. The plan's slots are spread in Spark and pieces
take them by joining on (length, rank within the length).
"""

from __future__ import annotations

import json
import string
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamwatch.llm.common import release_memory, saved

LIMIT = 4096
END_ID = 1
SALTS = 256
#: Words whose ids a worker remembers (up to twice as many for a while), and bytes of texts taken together (a longer text alone).
MOST_WORDS_KNOWN, BYTES_AT_ONCE = 400_000, 8_000_000
#: Marks that are words of their own after letters, and letters that normalization keeps letters without joining them to others.
#: Only scripts whose letters are letters in every version of Unicode are taken: Latin, Greek and Cyrillic.
MARKS, MARKED_BELOW = string.punctuation, "\u0530"
LETTERS = "".join(c for c in map(chr, range(ord(MARKED_BELOW)))
                  if c.isalpha() and (plain := unicodedata.normalize("NFC", c).lower()).isalpha() and max(plain) < MARKED_BELOW)


class WordIds:
    """Token ids of a text, word by word through a tokenizer that drops blanks.

    Such a tokenizer gives a text the ids of its blank-separated words in turn,
    so each distinct word is encoded once. Ids are kept as little-endian 32-bit
    numbers. What is remembered is bounded.

    A word of ``LETTERS`` and ``MARKS`` after them is put together from the two,
    so only letters, A-Z in lower case, and runs of marks are looked up for it.
    New words of letters go to the tokenizer together, as one text, if its
    vocabulary marks the ends of words: the ids are cut where a word ends, and
    each word is encoded for itself if that gives another number of words.
    """

    def __init__(self, tokenizer_json: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the words known before ``known`` was full; those met again move on

    def _each(self, words: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def _together(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters."""
        for at in range(0, len(words), 1000):
            some = words[at:at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                room, cuts = ids.tobytes(), (4 * cuts).tolist()
                yield from map(room.__getitem__, map(slice, [0, *cuts], cuts))
            else:
                yield from self._each(some)

    def _learn(self, new: list[str]) -> None:
        letters, rest = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        self.known.update(zip(letters, self._together(letters)))
        self.known.update(zip(rest, self._each(rest)))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; new ones are encoded together."""
        if len(self.known) > MOST_WORDS_KNOWN:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, words))
        lost = [i for i, x in enumerate(found) if x is None]
        if lost:
            new = [words[i] for i in lost]
            known.update([(w, before[w]) for w in new if w in before])
            self._learn([w for w in new if w not in before])
            for i, w in zip(lost, new):
                found[i] = known[w]
        return found

    def _column(self, words: pa.Array) -> pa.Array:
        """Ids of words that may repeat, by column."""
        words = words.dictionary_encode()
        return pa.array(self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, by column. A combining mark is in neither set, so it leaves its word whole."""
        marks = pc.utf8_ltrim(words, characters=LETTERS)
        apart = pc.equal(pc.binary_length(pc.ascii_rtrim(marks, characters=MARKS)), 0)
        stems = pc.if_else(apart, pc.ascii_lower(pc.ascii_rtrim(words, characters=MARKS)), words)
        marks = pc.if_else(apart, marks, pa.scalar("", words.type))
        return pc.binary_join_element_wise(self._column(stems), self._column(marks), pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: none). Words are split, made distinct and put back in place by column."""
        at, n = 0, len(texts)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < n:
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, side="right")))
            split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.slice(at, upto - at), ""), "\n", " "), " ")
            words = split.flatten().dictionary_encode()
            ids = self._words(words.dictionary).take(words.indices)  # one run of ids: a text's are a stretch of it
            _, places, room = ids.buffers()
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
            cuts = np.frombuffer(places, "<i8")[ids.offset + cuts].tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield room[a:b].to_pybytes()
            at = upto


def pieces(docs: DataFrame, tokenizer_json: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``limit`` tokens.

    Null text counts as empty: one piece that holds ``end_id`` alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json})  # one vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder = shared.value  # lives as long as the worker knows the broadcast: later tasks find the encoder and its words
        if "encode" not in holder:
            holder["encode"] = WordIds(holder["json"])
        encode = holder["encode"]
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(b.column(1))):
                ids += struct.pack("<I", end_id)
                for p, at in enumerate(range(0, len(ids) // 4, limit)):
                    cut = ids[4 * at:4 * (at + limit)]
                    rows.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release_memory()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, sequences, each, first sequence, offset):
    ``sequences`` consecutive sequences take ``each`` pieces of that length from
    ``offset`` on. Groups of sequences with equal room are handled at once, so
    the work depends on the number of lengths, not of pieces.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    rooms: list[int] = []
    slots, n_sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                n = -(-left // each)
                room, first = limit, n_sequences
                n_sequences += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full, each, first, limit - room))
                put(room - each * length, first, full)
                rank += full * each
                left -= full * each
                first, n = first + full, n - full
            if left and n:  # fewer pieces than one more sequence could take
                slots.append((length, rank, 1, left, first, limit - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return slots


def pack(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` (with a column length, from 1 to ``limit``) plus sequence_id and offset.

    Sequences hold at most ``limit`` tokens without gaps. Equal lengths fill
    slots in any order. Ranks within a length are counted in ``SALTS`` slices,
    so a length that a third of all pieces share is spread.
    """
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = saved(rows.select(names).withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")))
    sizes = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))  # at most limit * SALTS rows
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(*names)
    ranked = rows.withColumn("_in", F.row_number().over(within) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn(
        "_rank", F.col("_base") + F.col("_in"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= limit:
        raise ValueError(f"lengths must be from 1 to {limit}")
    spark = rows.sparkSession
    slots = spark.createDataFrame(plan(counts, limit), "sl bigint, rank bigint, n bigint, each bigint, seq bigint, at bigint")
    slots = (slots.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
             .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("each") - 1)).alias("j"))
             .select("sl", (F.col("rank") + F.col("i") * F.col("each") + F.col("j")).alias("sr"),
                     (F.col("seq") + F.col("i")).alias("sequence_id"), (F.col("at") + F.col("j") * F.col("sl")).alias("offset")))
    return ranked.join(slots, (F.col("length") == F.col("sl")) & (F.col("_rank") == F.col("sr"))).select(
        *names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_json: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and place; repeated rows are packed each by itself."""
    return pack(pieces(docs.select("doc_id", "text"), tokenizer_json, limit, end_id), limit)

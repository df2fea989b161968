"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A model is fitted from labelled texts: for each language the scripts it is
written in, and counts of character trigrams of its words. A word's score in a
language is the mean log-probability of its trigrams, only for languages of its
script. Viterbi finds the best sequence of languages over a text's words, where
each switch costs a penalty; the language of most letters is the text's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwatch.llm.common import release_memory

#: Labelled documents that the model is fitted on: at most so many of each language.
SAMPLE_PER_LANG = 1000
SWITCH = 6.0
SMOOTH = 0.5
SCRIPT_SHARE = 0.02
#: Bounds of a worker's memory: words remembered, cells (words x languages) of a round of Viterbi, texts taken from a batch at a time.
MOST_KNOWN = 300_000
MOST_CELLS = 4_000_000
TEXTS_AT_ONCE = 500
UNKNOWN = "und"
FOLDS = 5

# First code point of script ranges; letters outside all named scripts are "other".
SCRIPTS = ((0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
           (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
           (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3041, "kana"), (0x3100, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
           (0xFB13, "other"), (0x20000, "han"))
SCRIPT_STARTS = [s for s, _ in SCRIPTS]
RUN = re.compile(r"[^\W\d_]+")


def script(c: str) -> str:
    return SCRIPTS[max(0, bisect_right(SCRIPT_STARTS, ord(c)) - 1)][1]


def words_of(text: str) -> list[str]:
    """Runs of word characters without digits, lower-cased."""
    return RUN.findall(text.lower())


def trigrams(word: str) -> list[str]:
    """One for each character of the word."""
    w = f"^{word}$"
    return [w[i:i + 3] for i in range(len(word))]


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def main_script(word: str) -> str:
    return "latin" if word.isascii() else script(next(c for c in word if c.isalpha()))


class Model:
    """Languages in name order, their scripts, and trigram log-probabilities (one row of all languages each)."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, set[str]]) -> None:
        self.langs = sorted(counts)
        self.scripts = {s: np.array([s in scripts[x] for x in self.langs]) for s in sorted(set().union(*scripts.values()))}
        grams = sorted(set().union(*counts.values())) if counts else []
        totals = np.array([sum(counts[x].values()) + SMOOTH * (len(grams) + 1) for x in self.langs])
        table = np.array([[counts[x].get(g, 0) for x in self.langs] for g in grams] or np.empty((0, len(self.langs))), dtype=np.float64)
        self.rows = {g: i for i, g in enumerate(grams)}
        self.no_script = np.zeros(len(self.langs), dtype=bool)
        self.table = np.log((np.vstack([table, np.zeros(len(self.langs))]) + SMOOTH) / totals)

    def parts(self) -> dict:
        """The model as plain values, which workers can read without this package."""
        return {"langs": self.langs, "scripts": self.scripts, "rows": self.rows, "no_script": self.no_script, "table": self.table}

    @classmethod
    def of(cls, parts: dict) -> Model:
        model = cls.__new__(cls)
        model.__dict__.update(parts)
        return model

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of each word against its best language; languages of other scripts are far behind.

        A word of a script that no language is known in says nothing.
        """
        rows, miss = self.rows, len(self.rows)
        out = []
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            grams = [rows.get(g, miss) for w in some for g in trigrams(w)]
            s = np.add.reduceat(self.table[grams], np.cumsum([0] + [len(w) for w in some[:-1]]), axis=0)
            may = np.array([self.scripts.get(main_script(w), self.no_script) for w in some])
            s = np.where(may, s, -np.inf)
            top = s.max(axis=1, keepdims=True)
            out.append(np.where(np.isfinite(top), np.maximum(s - np.where(np.isfinite(top), top, 0), -12.0), 0.0))
        return np.concatenate(out)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on at most ``per_lang`` texts of each language, chosen by the hash of ``key``.

    The sample's ids (bounded) are broadcast by size; words and trigrams are
    counted in Spark, and only trigram counts come to the driver. Rows with a
    null text or language take no part.
    """
    from pyspark.sql import Window

    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    chosen = rows.select("k", "l").withColumn("nth", nth).where(F.col("nth") <= per_lang).select("k", "l")
    sample = rows.join(chosen, ["k", "l"], "left_semi")
    words = (sample.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))).alias("w"))
             .groupBy("l", "w").agg(F.count("*").alias("n")))
    # A short list of distinct words per language and trigram; counts in proportion to the sample.
    w = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    grams = (words.select("l", "n", w.alias("w"), F.explode(F.sequence(F.lit(1), F.length(w) - 2)).alias("i"))
             .select("l", "n", F.substring("w", F.col("i"), F.lit(3)).alias("g")).groupBy("l", "g").agg(F.sum("n").alias("n")))
    counts: dict[str, dict[str, int]] = {}
    for r in grams.toLocalIterator():
        counts.setdefault(r["l"], {})[r["g"]] = r["n"]
    scripts = {}
    for x, found in counts.items():
        seen: dict[str, int] = {}
        for g, n in found.items():
            if len(g) > 1 and g[1].isalpha():
                seen[script(g[1])] = seen.get(script(g[1]), 0) + n
        scripts[x] = {s for s, n in seen.items() if n >= SCRIPT_SHARE * sum(seen.values())}
    return Model(counts, scripts)


class Labeller:
    """Viterbi over many texts at a time: one step for the t-th words of all of them."""

    def __init__(self, model: Model, switch: float = SWITCH) -> None:
        self.model, self.switch = model, switch
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.langs)))
        self.weights: list[int] = []
        self.new: list[str] = []

    def _row(self, word: str) -> int:
        """Row of a new word, to be scored with the others that are new."""
        if not has_letter(word):
            return -1
        self.new.append(word)
        self.weights.append(len(word))
        return len(self.weights) - 1

    def _ids(self, words: list[str]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = self._row(w)
            out.append(i)
        ids = np.array(out, dtype=np.int64)
        return ids[ids >= 0]

    def _score_new(self) -> None:
        n = len(self.weights)
        if n > len(self.scores):
            more = np.zeros((max(n, 2 * len(self.scores)), len(self.model.langs)))
            more[:n - len(self.new)] = self.scores[:n - len(self.new)]
            self.scores = more
        self.scores[n - len(self.new):n] = self.model.score(self.new)

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text, in order. Spans: first word, word after the last, language."""
        n_langs = len(self.model.langs)
        at = 0
        while at < len(texts):
            if len(self.known) > MOST_KNOWN:
                self._forget()
            ids, cells = [], 0
            while at < len(texts) and (not ids or cells < MOST_CELLS):
                ids.append(self._ids(words_of(texts[at] or "")))
                cells += len(ids[-1]) * max(1, n_langs)
                at += 1
            if self.new and n_langs:
                self._score_new()
            self.new = []
            yield from self._viterbi(ids)

    def _viterbi(self, ids: list[np.ndarray]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        langs = self.model.langs
        if not langs:
            yield from ((UNKNOWN, 0.0, []) for _ in ids)
            return
        order = np.argsort([-len(x) for x in ids], kind="stable")
        sizes = np.array([len(ids[i]) for i in order])
        flat = np.concatenate([ids[i] for i in order]) if len(ids) else np.empty(0, np.int64)
        starts = np.cumsum(np.r_[0, sizes])[:-1]
        labels = np.empty(len(flat), dtype=np.int16)
        steps = int(sizes[0]) if len(sizes) else 0
        active = [int(x) for x in np.searchsorted(-sizes, -np.arange(steps), side="left")]  # texts longer than t
        table = self.scores
        best = np.empty(len(flat), dtype=np.int16)  # best language before each word
        switched = np.zeros((len(flat), len(langs)), dtype=bool)
        total = np.zeros((len(ids), len(langs)))
        for t in range(steps):
            n = active[t]
            where = starts[:n] + t
            v = total[:n]
            if t:
                top = v.argmax(axis=1)
                limit = v[np.arange(n), top] - self.switch
                sw = v < limit[:, None]
                best[where], switched[where] = top, sw
                v = np.maximum(v, limit[:, None])
            total[:n] = v + table[flat[where]]
        now = total.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            where = starts[:n] + t
            labels[where] = now[:n]
            if t:
                now[:n] = np.where(switched[where, now[:n]], best[where], now[:n])
        weights = np.array(self.weights, dtype=np.int64)
        back = np.empty(len(ids), dtype=np.int64)
        back[order] = np.arange(len(ids))
        for i in back:
            s, n = starts[i], sizes[i]
            if not n:
                yield UNKNOWN, 0.0, []
                continue
            mine = labels[s:s + n]
            share = np.bincount(mine, weights=weights[flat[s:s + n]], minlength=len(langs))
            top = int(share.argmax())
            cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True])
            yield langs[top], float(share[top] / share.sum()), [(int(a), int(b), langs[mine[a]]) for a, b in zip(cuts, cuts[1:])]


def label_languages(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH,
                    keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) plus lang_pred, lang_score, lang_spans.

    lang_pred is a language of the model, or ``und`` for texts that are null or
    have no letter; lang_score is the share of its letters. Input columns with
    these names are replaced. Repeated rows each get a row.
    """
    names = ("lang_pred", "lang_score", "lang_spans")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    # a text that is kept travels once
    own = text not in keep or docs.schema[text].dataType.simpleString() != "string"
    rows = docs.select(*keep, *([F.col(text).cast("string").alias("_lang_text")] if own else []))
    at = len(keep) if own else keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # bounded: trigrams of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model.of(shared.value), switch)
        span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in (x.slice(i, TEXTS_AT_ONCE) for x in batches for i in range(0, max(1, x.num_rows), TEXTS_AT_ONCE)):
            found = list(labeller.label(b.column(at).to_pylist()))
            spans = [[{"first": a, "end": e, "lang": x} for a, e, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array(spans, span)], names=[*keep, *names])
        del labeller
        release_memory()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)])
    return rows.mapInArrow(run, (fields + ", " if fields else "") +
                           "lang_pred string, lang_score double, lang_spans array<struct<first:int,end:int,lang:string>>")


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the model learns from documents outside fold 0 only."""
    model = fit(docs.where(fold(F.col("doc_id")) != 0))
    return label_languages(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

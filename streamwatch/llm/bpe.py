"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state whose arcs are the single
symbols. Each merge (u, v) -> w, in rank order, adds a gadget: reading u now
leads to a copy of its state without the arc v; where u could be read and its
state still had v, w can be read too, and leads where v led. After all merges
the automaton accepts exactly the correct tokenizations: a word's symbols are
spelled by one accepted path.

The state after an arc depends on its label alone, and a state differs from the
one it was copied from by one arc. So the compiled automaton is a table of
gadgets: per merge its parts and rank, per pair of parts its merge. An arc is
followed through the gadgets back to one that decides it, and what is found is
kept in a transition table. Encoding reads a word from left to right: at each
position one arc ends that continues an accepted path. Decoding emits labels.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KNOWN = 800_000


def byte_symbols() -> dict[int, str]:
    """Printable stand-in of each byte in byte-level vocabularies: itself, or the next unused one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(plain))
    return out


class Automaton:
    """Compiled merges. Tokens are vocabulary ids; unreachable ones have no arcs.

    ``units``: a token's spelling with one character for each symbol; a symbol
    that ends a word has a character of its own, ``END`` above that of the plain one.
    """

    END = 0x1000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left part, right part, rank)
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.steps = len(merges)
        spelling = {t: t for t in vocab if len(t) == 1}
        if suffix:
            spelling |= {t: chr(ord(t[0]) + self.END) for t in vocab if len(t) == 1 + len(suffix) and t.endswith(suffix)}
        for rank, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], rank)
            spelling[u + v] = spelling[u] + spelling[v]
        self.units = {x: vocab[t] for t, x in spelling.items() if len(x) == 1 or vocab[t] in self.parts}
        self.size = {t: len(x) for x, t in self.units.items()}
        self.first: dict = {}  # arc labels as a tree of symbols; None holds the label that ends there
        self.shorter: dict[int, int | None] = {}  # label -> longest label that begins it
        for x, t in self.units.items():
            node = self.first
            for c in x:
                node = node.setdefault(c, {})
            node[None] = t
            self.shorter[t] = next((self.units[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in self.units), None)

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        """One merge step: u's state loses the arc v, and w enters where u could be read before v."""
        if w in self.parts or not self._arc(u, v, rank):
            return  # u is never followed by v at this point, or w is there already
        self.parts[w] = (u, v, rank)
        self.merge_rank[u, v] = rank

    def _born(self, t: int) -> int:
        return self.parts[t][2] if t in self.parts else -1

    def _arc(self, a: int, b: int, before: int) -> bool:
        """Whether b can be read after a once the merges of rank below ``before`` are in place."""
        while True:
            rank = self.merge_rank.get((a, b))
            if rank is not None and rank < before:
                return False
            born_a, born_b = self._born(a), self._born(b)
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:  # a's state is that of its right part when a was added, before that gadget's cut
                a, before = self.parts[a][1], born_a
            elif born_b > born_a:  # b was added where its left part could be read after that gadget's cut
                b, before = self.parts[b][0], born_b + 1
            else:  # the same token twice: its left part after its right part
                u, v, before = self.parts[a]
                a, b = v, u

    def follows(self, a: int, b: int) -> bool:
        """Transition table: whether the state after a has the arc b."""
        known = self.arcs.get((a, b))
        if known is None:
            if len(self.arcs) > 4 * MOST_KNOWN:
                self.arcs.clear()
            known = self.arcs[a, b] = self._arc(a, b, self.steps)
        return known

    def longest(self, word: str, at: int) -> int | None:
        """Longest label that ``word`` has at a position."""
        node, found = self.first, None
        for c in (word[at:] if at else word):
            node = node.get(c)
            if node is None:
                break
            if None in node:
                found = node[None]
        return found

    def encode(self, word: str) -> list[int]:
        """Labels of the accepted path that spells ``word`` (characters as in ``units``).

        Long arcs are tried first. A prefix has one accepted path, so a position
        that was left once is not entered again: the work is linear in the word.
        """
        out: list[int] = []
        left: set[int] = set()
        at, n, size = 0, len(word), self.size
        t = self.longest(word, 0)
        while at < n:
            if t is None:
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                left.add(at)
                t = out.pop()
                at -= size[t]
                t = self.shorter[t]
                continue
            end = at + size[t]
            if end not in left and (not out or self.follows(out[-1], t)):
                out.append(t)
                at = end
                t = self.longest(word, at) if at < n else None
            else:
                t = self.shorter[t]
        return out


class Codec:
    """The whole tokenizer of a file: added tokens, normalization, pre-split words, automaton."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE models are read")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in (model["vocab"] | self.added).items()}
        self.decoder = spec["decoder"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]) or self.decoder:
            raise ValueError("added tokens that are normalized or take blanks, and decoders, are not read")
        self.steps = spec["normalizer"]["normalizers"] if spec["normalizer"]["type"] == "Sequence" else [spec["normalizer"]]
        self.steps = [s | {"find": regex.compile(s["pattern"]["Regex"])} if s["type"] == "Replace" else s for s in self.steps]
        pre = spec["pre_tokenizer"]
        pre = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        split, level = pre
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" \
                or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("only a word pattern followed by bytes is read")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.symbols = byte_symbols()
        self.automaton = Automaton(model["vocab"], merges, self.suffix)
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def normalize(self, text: str) -> str:
        for step in self.steps:
            if step["type"] == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step["type"] == "Replace":
                text = step["find"].sub(step["content"], text)
            elif step["type"] == "Lowercase":
                # Character by character: a final sigma is like any other.
                text = text.lower() if "Σ" not in text else "σ".join([p.lower() for p in text.split("Σ")])
            else:
                raise ValueError(f"normalizer {step['type']} is not read")
        return text

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            symbols = "".join([self.symbols[b] for b in word.encode()])
            if self.suffix:
                symbols = symbols[:-1] + chr(ord(symbols[-1]) + Automaton.END)
            ids = tuple(self.automaton.encode(symbols))
            if len(word) < 64:
                self.known[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        out = []
        for w in self.pattern.findall(self.normalize(text)):
            out += self.word(w)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``. Blanks separate words and give no ids, so text between them is encoded once."""
        out, chunks = [], self.chunks
        for c in text.replace("\n", " ").split(" "):
            ids = chunks.get(c)
            if ids is None:
                if self.special is None or self.special.search(c) is None:
                    ids = self._plain(c)
                else:
                    ids = []
                    for i, part in enumerate(self.special.split(c)):
                        ids += [self.added[part]] if i % 2 else self._plain(part)
                if len(chunks) > MOST_KNOWN:
                    chunks.clear()
                if len(c) < 64:
                    chunks[c] = tuple(ids)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Labels joined by one space: what a file without a decoder decodes to."""
        return " ".join(map(self.labels.__getitem__, ids))


def encode_documents(docs: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids of each row's whole text, and the text they decode to.

    Null text counts as empty (no ids); repeated rows each get a row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string")


def bpe_report(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    e = encode_documents(docs, tokenizer_json)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))

"""Word ids against the tokenizers library, and queries whose workers cannot import the package."""

import os
import random
import string
import struct
import subprocess
import sys

import pyarrow as pa

from streamwatch.llm import packing, queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Letters that normalization takes apart or lower-casing lengthens, marks that join, and plain ones.
ODD = "aZé ß\n\tİıǰŉΣςσয়ড়াक़̧́ͅﬁ一ﬀẞǅİᾳΩÅ్ำ‍ '.,;:!?-<|>0٣😀"


def test_word_ids_equal_the_library():
    words = packing.WordIds(queries.tokenizer_json())
    rng = random.Random(11)
    texts = ["হয়, বড়. İ. DİLİ. ΟΔΟΣ. don't. Ｆｏｏ. ǰ! straße?", "", "<|endoftext|>. x<|startoftext|>,"]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 24))) for _ in range(40_000)]
    texts += [f"{chr(c)}{m} a{chr(c)}{m} {chr(c)}b{m}" for c in range(0x21, 0x3100) if not 0xD800 <= c < 0xE000 for m in ".?"]
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, found, e in zip(texts, words(pa.array(texts)), want):
        assert found == struct.pack(f"<{len(e.ids)}I", *e.ids), repr(text)


def test_a_word_is_looked_up_once_however_it_is_written():
    words = packing.WordIds(queries.tokenizer_json())
    texts = ["Word word, WORD. word!\nwOrd ... Été, été.", "", None, "Été..."]
    want = words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert list(words(pa.array(texts))) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in want]
    assert set(words.known) == {"word", "Été", "été", "", ",", ".", "!", "..."}


def test_capitals_that_normalization_joins_to_marks():
    words = packing.WordIds(queries.tokenizer_json())
    texts = [f"{c}{m} a{c}{m}. {c}{m}b, {c}.{m}" for c in string.ascii_letters for m in map(chr, range(0x300, 0x370))]
    texts += [f"A{chr(c)}B{m} {chr(c)}Z{m} {chr(c).upper()}{m}{chr(c)}" for c in range(0x21, 0x600) for m in ",'"]
    texts += ["<|EndOfText|>, <|endoftext|>, A<|endoftext|>. <|ENDOFTEXT|>", "\u212a\u030c. K\u030c. J\u030c! It's IT'S 's. 'S", "", "\n", "  "]
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    for kind in (pa.string(), pa.large_string()):
        for text, found, e in zip(texts, words(pa.array(texts, kind)), want, strict=True):
            assert found == struct.pack(f"<{len(e.ids)}I", *e.ids), repr(text)
    for text in ("", None, "\n", "  "):
        assert list(words(pa.array([text], pa.string()))) == [b""]


def test_words_are_forgotten_without_changing_ids(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(30)) for _ in range(3000)]
    plain = list(packing.WordIds(queries.tokenizer_json())(pa.array(texts)))
    monkeypatch.setattr(packing, "MOST_WORDS_KNOWN", 300)
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 2000)
    few = packing.WordIds(queries.tokenizer_json())
    assert list(few(pa.array(texts))) == plain and len(few.before) < 10_000


def test_workers_without_the_package(tmp_path):
    """Every Python operator runs where workers start in another folder and have no copy of the package."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys, os
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1200]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1000m")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / 'ck')!r})
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
from streamwatch.llm import queries
for name in ("op4_packing", "op10_language", "op11_fim", "op12_whitening"):
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == ["op4_packing", "op10_language", "op11_fim", "op12_whitening"]

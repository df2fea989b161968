"""Training-data operators against brute force, on small and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streamwatch.llm import (ann, bpe, common, components, fingerprints, html_extract, langid, line_dedup, packing, queries, secret_scan,
                             simhash_dedup, substrings)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, " \n\t ", "de", None, 4), (None, "the cat", "en", "s", 7),
       (4, "wörter und " * 3000, "de", None, 33000), (5, "the cat sat on the mat", "en", "t", 22), (6, "the cat sat on the mat", "en", "t", 22),
       (7, "一二三 😀 <|endoftext|> password: \"hunter2hunter\"", "en", "t", 40)]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("n", F.lit(1)).withColumn("host", F.lit("x")).withColumn("key", F.lit(2)).withColumn("fp", F.lit(3))


def texts(spark, n=None):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows][:n]


def test_every_operator_takes_odd_and_empty_tables(spark):
    tok = queries.tokenizer_json()
    model = langid.Model({"en": {"^th": 1}}, {"en": {"latin"}})
    ops = {
        "line": line_dedup.drop_site_lines, "near": simhash_dedup.near_duplicates, "pack": lambda d: packing.pack_documents(d, tok).where("piece = 0"),
        "secrets": secret_scan.find_secrets, "bpe": lambda d: bpe.encode_documents(d, tok), "prints": fingerprints.fingerprint_report,
        "lang": lambda d: langid.label_languages(d, model)}
    for name, op in ops.items():
        assert op(odd(spark)).count() == len(ODD), name
        assert op(spark.createDataFrame([], DOCS)).count() == 0, name
    assert substrings.drop_repeats(odd(spark)).count() == len({r[0] for r in ODD})
    assert substrings.drop_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert langid.language_report(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash_dedup.drop_near_duplicates(odd(spark)).columns == odd(spark).columns


def test_line_dedup(spark):
    rows = [(i, f"menu\n line {i}\nmenu " if i % 2 else f"body {i}", "a") for i in range(20)] + [(99, "menu", "b"), (98, "x\n\nx", None)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_site_lines(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == (" line 1", 3, 2) and got[0] == ("body 0", 1, 0)
    assert got[99] == ("menu", 1, 0) and got[98] == ("x\n\nx", 3, 0)


def test_line_dedup_equals_sql(spark):
    import duckdb
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    exp = sorted(duckdb.sql(queries.SQL["op1_line_dedup"]).fetchall())
    assert sorted(map(tuple, queries.op1_line_dedup(spark, SF).collect())) == exp


def test_copies_of_a_document_leave_one_with_its_text(spark):
    import corpus_pipeline
    copy = "alpha beta gamma\ndelta epsilon zeta\n\neta theta iota"
    rows = [(i, copy + " " * (i % 2) if i % 3 == 0 else f"menu\nown line {i} of number {i * 7919}\nanother {i * 104729}", "en", "s", 1) for i in range(30)]
    rows += [(100 + i, "one line only" if i < 5 else f"text {i} {i * 7907}", "en", "t", 1) for i in range(15)]
    docs = corpus_pipeline.site_line_dedup(spark, spark.createDataFrame(rows, DOCS), SF)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left[0] == copy and left[100] == "one line only" and all(t.strip() for t in left.values())
    assert not any(t.startswith("menu") for t in left.values())
    kept = [r.text for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert kept.count(copy) == 1 and kept.count("one line only") == 1 and "" not in kept


def _base_spans(text):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    out = [(m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m.group(g)) >= n]
    return ",".join(f"{kinds[i][0]}:{s}:{e}" for s, i, e in sorted(out))


def test_secret_spans_and_redaction(spark):
    rnd = random.Random(1)
    bits = ["password=", "Token : '", "api_key=", "secret", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2, "é😀", " ", "x", "=", ":abcdef", "token:", "12345"]
    cases = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    cases.append("key is Zx8Qv3LmT0pRk7Wd2Ys9Bn4Hc6Jf1Gq5 here")
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    samples = secret_scan.labelled_samples(df)
    words = spark.createDataFrame([("internationalization_settings", False), ("getUserAccountInformation", False), ("mail.example.com.example", False)] * 50,
                                  "token string, is_secret boolean")
    samples = words.unionByName(samples.where("is_secret"))
    found = secret_scan.find_secrets(df, samples=samples).withColumn("red", secret_scan.redacted(F.col("text"), F.col("spans")))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    for r in found.select("doc_id", "text", secret_scan.span_string(base).alias("base"), secret_scan.span_string(F.col("spans")).alias("all"), "red").collect():
        assert r.base == _base_spans(r.text)
        if r.doc_id == len(cases) - 1:
            assert r["all"] == "markov:7:39" and r.red == "key is [SECRET] here"
        if not r["all"]:
            assert r.red == r.text


@pytest.mark.parametrize("copies", [1, 1000])
def test_bare_secrets_are_found_without_samples(spark, copies):
    rnd = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rnd.choice(chars) for _ in range(32)) for _ in range(30)]
    plain = ["getUserAccountInformation", "internationalization_settings", "mail.corporate.example.com", "=" * 30, "12345678901234567890",
             "/var/lib/postgres/backups/latest.tar.gz", "verschwiegenheitserklaerung", "release-notes-2021-03-04.html"]
    rows = [(i, f"the value {s} stands here") for i, s in enumerate(secrets * copies)] + [(-1 - i, f"see {t} there") for i, t in enumerate(plain)]
    found = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.select("doc_id", secret_scan.span_string(F.col("spans")).alias("spans")).groupBy((F.col("doc_id") < 0).alias("plain"), "spans").count().collect()
    assert {(r["plain"], r["spans"]): r["count"] for r in got} == {(False, "markov:10:42"): len(secrets) * copies, (True, ""): len(plain)}


def _brute_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = texts(spark)
    fps = {d: _brute_simhash(t or "") for d, t in rows}
    exp = {d: (f"{f:016x}", c) for (d, f), c in zip(fps.items(), _components(fps).values())}
    got = {r[0]: (r[1], r[2]) for r in simhash_dedup.near_duplicates_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == exp


@pytest.mark.parametrize("block", [2_000_000, 3000])
def test_links_connect_what_three_bits_connect(spark, block, monkeypatch):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(rnd.randint(0, 12)):
            f ^= sum({1 << rnd.choice(range(64)) for _ in range(rnd.randint(1, 4))})
            fps.add(f)
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    exp = _components(fps)
    df = spark.createDataFrame([(simhash_dedup.signed(f),) for f in fps.values()], "fp long")
    links = simhash_dedup.links(df)
    root = {r.node: r.root for r in components.connected_components(links).collect()}
    groups = {}
    for i, f in fps.items():
        groups.setdefault(root.get(simhash_dedup.signed(f), ("alone", i)), set()).add(i)
    brute = {}
    for i, c in exp.items():
        brute.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_packing_is_gapless_and_tight(spark):
    tok = queries.tokenizer_json()
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(tok)
    rows = texts(spark) + [(-1, None), (-2, "a\x1cb　c<|endoftext|>d İstanbul word. x."), (-3, "ab " * 9000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tok).collect()
    exp = {}
    for d, s in rows:
        ids = t.encode(s or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at:at + 4096]
            exp[d, p] = (at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == exp
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(seqs) <= -(-sum(x[1] for x in exp.values()) // 4096) + 1


def test_plan_places_every_piece_once():
    rnd = random.Random(3)
    for _ in range(200):
        limit = rnd.randint(1, 60)
        counts = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, limit + 1), rnd.randint(1, min(limit, 12)))}
        room, seen = {}, {}
        for length, rank, n, each, seq, at in packing.plan(counts, limit):
            for i in range(n):
                for j in range(each):
                    seen.setdefault(length, []).append(rank + i * each + j)
                    room.setdefault(seq + i, []).append((at + j * length, length))
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in counts.items()}
        for s in room.values():
            end = 0
            for a, length in sorted(s):
                assert a == end
                end += length
            assert end <= limit


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer
    tok = queries.tokenizer_json()
    codec, t = bpe.Codec(tok), Tokenizer.from_str(tok)
    rnd = random.Random(4)
    cases = ["".join(rnd.choice("aaabnheTHE'st 01 \t\n\x1c\x85éßΣσİﬁ中文é😀👍🏽-!<>|") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    cases += ["a<|endoftext|>b", "I'LL don't", "ΑΣ", "a" * 700, ""]
    for s, e in zip(cases, t.encode_batch(cases, add_special_tokens=False)):
        assert codec.encode(s) == e.ids
        assert codec.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("piece", [4096, 2])
def test_substrings_equal_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", piece)
    rnd = random.Random(5)
    pool = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 40))] for _ in range(12)]
    rows = [(d, " ".join(sum([rnd.choice(pool) if rnd.random() < .6 else [rnd.choice("xyz")] * rnd.randint(1, 9) for _ in range(rnd.randint(0, 6))], [])))
            for d in range(120)]
    for window, seed in ((20, 6), (5, 5)):
        seen, exp = set(), {}
        for d, t in rows:
            w = t.split()
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                if k in seen:
                    gone[i:i + window] = [True] * window
                seen.add(k)
            exp[d] = " ".join(x for x, g in zip(w, gone) if not g)
        got = {r.doc_id: r.kept for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, seed).collect()}
        assert got == exp


def test_fingerprint_report(spark):
    rows = texts(spark, 80)
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()
    for (d, t), (nd, nt) in zip(rows, rows[1:] + rows[:1]):
        t, nt = t or "", nt or ""
        e = t[:len(t) - len(t) // 2] + nt[:len(t) // 2]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, got[nd].fingerprint)


def test_block_tables_find_all_within_radius(spark):
    rnd = random.Random(6)
    a = [rnd.getrandbits(63) for _ in range(30)]
    b = [x ^ sum({1 << rnd.randrange(63) for _ in range(rnd.randint(0, 6))}) for x in a] + [rnd.getrandbits(63) for _ in range(50)]
    q, c = (spark.createDataFrame([(x,) for x in v] + [(None,)], "fp long") for v in (a, b))
    got = {(r.query, r.fp, r.bits) for r in fingerprints.within_radius(q, c, 4).collect()}
    assert got == {(x, y, (x ^ y).bit_count()) for x in set(a) for y in set(b) if (x ^ y).bit_count() <= 4}


def test_nearest_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    got = {}
    bad = [(9000, None), (9050, [float("nan")] * 64), (9100, [0.0] * 64), (9150, [1.0]), (9200, [])]
    both = df.select("vec_id", "embedding").unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    for r in ann.nearest_report(both).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, x in rows:
        if q % 50 == 0:
            exp = sorted(((-x @ y / np.sqrt((x @ x) * (y @ y)), v) for v, y in rows if v != q))[:5]
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
            for _, v, s in mine:
                y = dict(rows)[v]
                assert abs(s - x @ y / np.sqrt((x @ x) * (y @ y))) < 1e-9
            hits += len({v for _, v in exp} & {v for _, v, _ in mine})
            total += 5
    assert hits / total >= 0.9 and not set(got) & {b[0] for b in bad}
    assert ann.nearest_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.001])
def test_nearest_recall_in_a_tight_group(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2000] = x[0] + spread * x[:2000]
    x = x.astype(np.float32)
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, "vec_id < 2000 and vec_id % 40 = 1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(1, 2000, 40):
        sims = unit @ unit[q]
        sims[q] = -2
        hits += len(got[q] & set(np.argsort(-sims)[:5].tolist()))
    assert hits >= 0.9 * 5 * 50


def test_hilbert_curve_is_a_curve():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_main_text(spark):
    page = """<html><head><title>T</title><script>"</p>"</script></head><body><div class="site-top">Brand</div><nav>menu</nav>
    <article><header>By X</header><h1>Big &amp; tall</h1><p>One<br>two <b>three</b><p>Shared line.</p><div class="share">Share</div>
    <div>Sign up now</div><ul><li>a</li><li>b</li></ul><section class="comments"><p>nice</p></section></article><footer>f</footer></body></html>"""
    rows = [(i, f"http://h.example/{i}", page.replace("One", f"One{i}")) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://o.example", "<p>plain a < b &lt;i&gt;"), (53, "http://o.example", "<article><p>cut &am"), (53, "u", "t<p")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = [(i, f"Big & tall One{i} two three Shared line. a b") for i in range(12)] + [(50, ""), (51, ""), (52, "plain a < b <i>"), (53, "cut &am"), (53, "t")]
    assert sorted(x[:2] for x in got) == sorted(want) and all(n == len(t) for _, t, n in got)


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    model = langid.Model({"aa": {"^aa": 9, "aaa": 9, "aa$": 9}, "bb": {"^bb": 9, "bbb": 9, "bb$": 9}, "ru": {"^да": 5, "да$": 5}},
                         {"aa": {"latin"}, "bb": {"latin"}, "ru": {"cyrillic"}})
    cases = ["aaa " * 9 + "bbbb " * 9, "да да", "123 ...", None, "中文", "aaa " * 9 + "bb " + "aaa " * 9]
    found = list(langid.Labeller(model).label(cases))
    assert found[0][2] == [(0, 9, "aa"), (9, 18, "bb")] and found[1][0] == "ru"
    assert found[2] == ("und", 0.0, []) == found[3] and found[4][0] in model.langs
    assert found[5][0] == "aa" and len(found[5][2]) == 1


def _viterbi(scores, switch):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        s = sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        best = max(best, s) if best is not None else s
    return best


def test_viterbi_finds_the_best_path():
    rnd = np.random.default_rng(7)
    model = langid.Model({"a": {"x": 1}, "b": {"y": 1}, "c": {"z": 1}}, {"a": {"latin"}, "b": {"latin"}, "c": {"latin"}})
    lab = langid.Labeller(model, switch=2.0)
    lab.scores, lab.weights = rnd.normal(size=(30, 3)) * 2, [1] * 30
    ids = [rnd.integers(0, 30, size=n) for n in (6, 0, 3, 7, 1)]
    for x, (_, _, spans) in zip(ids, lab._viterbi(ids)):
        if len(x):
            path = [lab.model.langs.index(s[2]) for s in spans for _ in range(s[0], s[1])]
            mine = sum(lab.scores[i, p] for i, p in zip(x, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            assert abs(mine - _viterbi(lab.scores[x], 2.0)) < 1e-9


def test_bucket_of(spark):
    bounds = sorted(random.Random(8).sample(range(1000), 57))
    got = spark.range(1000).select("id", common.bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = {}
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema=stage(spark, docs, SF).schema)
        out[name] = docs
    first = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id: r.text for r in out["language_id"].collect()}
    assert all(any(c.isalpha() for c in t) for t in kept.values()) and len(kept) >= 0.97 * len(first)
    lined = {r.doc_id: r for r in out["line_dedup"].collect()}
    assert set(lined) == set(kept) and all(r.n_chars == len(r.text) for r in lined.values() if r.text != first[r.doc_id].text)
    roots = _components({d: _brute_simhash(r.text) for d, r in lined.items()})
    deduped = {r.doc_id for r in out["simhash_dedup"].collect()}
    assert deduped == set(roots.values())
    clean = {r.doc_id: r.text for r in out["secret_scan"].collect()}
    assert set(clean) == deduped and not any(_base_spans(t) for t in clean.values())
    assert {r.doc_id for r in out["packing"].collect()} == deduped

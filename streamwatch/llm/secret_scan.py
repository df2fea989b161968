"""Secret scan (native): base patterns, plus random-looking tokens by character Markov models.

Two first-order models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples. A token is a secret if
the log-likelihood ratio of the two models over its transitions exceeds
``MIN_LLR``. No token that is scored is a sample: the ordinary ones are generated
from a list of words, and words of the corpus too short to be scored. Offsets
count code points; ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwatch.llm.common import fresh, literal_array

# Base patterns, in the order in which kinds are listed, with (checked group, least length).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
KINDS = tuple(k for k, *_ in BASE) + ("markov",)
LEAST_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=.-]{{{LEAST_TOKEN},}}"
#: Of a run of token characters too short to be scored: the word in it, if it is one.
RUN, WORD = r"[^A-Za-z0-9+/_=.-]+", rf"^([A-Za-z]?[a-z]{{1,{LEAST_TOKEN - 2}}})[.]?$"
#: Random strings in the default labelled samples, for each of their shapes.
RANDOM_SAMPLES = 2000
SMOOTH = 0.5
BACK_OFF = 5.0
ALPHABET = 67
MIN_LLR = 12.0
#: Parts of the generated identifiers.
WORDS = tuple("""account action address admin agent alert api app archive array async audio auth backup base batch block body
 bucket buffer build button byte cache call case change channel check child class client cloud cluster code column command
 commit common config connect console content context control convert cookie copy core count create current custom data
 database date debug default delete deploy design detail device dialog digest disk docker document domain download driver
 edit element email enable engine entry error event example execute export factory feature field file filter final find
 flag folder font form format frame function gateway general get global graph group guide handle handler header health
 height history home hook host http icon image import index info init input install instance internal international
 invoice issue item java job json key label language layer layout level library license light limit line link list load
 local lock logger login machine main manager manifest map market master matrix media member memory menu message method
 metric migration mobile model module monitor mouse multiple native network node normal notification number object office
 open option order output owner package page parameter parse partner password path payment permission person phone photo
 pipeline platform player plugin point policy pool port post preview price primary print private process product profile
 project property protocol provider proxy public purchase quality query queue quick random range rate read record region
 register release remote render report request require reset resource response result return review role root route rule
 sample save scale schedule schema scope screen script search second section security select send sequence server service
 session setting share shell shop simple site size socket source space spark split stack standard start state static
 status storage store stream string style submit summary support switch symbol sync system table target task team temp
 template test text theme thread thumbnail time title toggle token tool total trace track transaction transfer travel tree
 trigger type unit update upload user util valid value vector vendor version video view visible volume wallet warning web
 weekly weight widget width window word worker workflow write year zone""".split())
ENDS = ("com", "org", "net", "de", "fr", "html", "php", "json", "xml", "py", "java", "jpg", "png", "pdf", "txt", "tar.gz")
RULES = "=-_./+"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: Column, regex: str, kind: int, group: int, least: int) -> Column:
    """Spans of all leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    Positions follow from the lengths of the matches and of the pieces between them.
    """
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    checked = whole if group == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    pieces = F.split(text, regex, -1)
    rows = F.transform(F.arrays_zip(whole.alias("m"), checked.alias("g"), F.slice(pieces, 1, F.size(whole)).alias("p")),
                       lambda x: F.struct(F.length(x["p"]).cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("len"),
                                          F.length(x["g"]).alias("g")))
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end")))
        return F.struct((start + x["len"]).alias("pos"),
                        F.when(x["g"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def _base(text: Column, spec: tuple[str, str, int, int]) -> Column:
    name, regex, group, least = spec
    # A run of hex digits shorter than `least` cannot pass: require the length before the costly steps.
    probe = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}[name]
    return F.when(text.rlike(probe), _matches(text, regex if name != "hex" else r"[0-9a-f]{24,}",
                                              KINDS.index(name), group, least)).otherwise(F.array().cast(SPAN))


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _base_spans(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    names = fresh(docs, *(f"spans_{k}" for k, *_ in BASE))
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", *[_base(t, spec).alias(n) for n, spec in zip(names, BASE)]), names


def random_strings(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """(token): ``n`` random-looking strings of each shape (hex in both cases, base64, its URL form, capitals)."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "[\\r\\n=]", "")
    shapes = [F.substring(h("a"), 1, 40), F.upper(F.substring(h("b"), 1, 40)), b64("c"),
              F.translate(b64("d"), "+/", "-_"), F.upper(F.regexp_replace(b64("e"), "[+/]", ""))]
    return spark.range(n).select(F.explode(F.array(*shapes)).alias("token"))


def ordinary_identifiers(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """(token): ``n`` identifiers of each common shape out of ``WORDS``, numbers, dates, and rules of one character."""
    def pick(values: tuple, salt: str) -> Column:
        return F.get(literal_array(list(values), "string"), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))).cast("int"))

    number = lambda top, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top)).cast("string")
    two = lambda top, salt: F.lpad((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top)) + 1).cast("string"), 2, "0")
    w = [F.col(f"w{i}") for i in range(5)]
    words = spark.range(n).select("id", *[pick(WORDS, f"w{i}").alias(f"w{i}") for i in range(5)], pick(ENDS[:5], "e").alias("top"),
                                  pick(ENDS[5:], "f").alias("ext"), (F.lit(1990) + F.col("id") % 50).cast("string").alias("year"))
    caps = [F.initcap(x) for x in w]
    date = [F.col("year"), two(12, "m"), two(28, "d")]
    shapes = [
        F.concat_ws("_", *w[:4]), F.upper(F.concat_ws("_", *w[1:4])), F.concat_ws("-", *w[:4]), F.concat(w[0], *caps[1:4]), F.concat(*caps[:4]),
        F.concat(*w[:3]), F.concat_ws(".", F.col("top"), *w[:3], F.concat(*caps[3:])), F.concat(F.lit("/"), F.concat_ws("/", *w[:4]), F.lit("."), "ext"),
        F.concat(F.lit("//www."), w[0], w[1], F.lit("."), "top", F.lit("/"), w[2], F.lit("/"), w[3], F.lit("-"), w[4], F.lit("."), "ext"),
        F.concat(w[0], F.lit("-"), w[1], F.lit("-"), number(12, "a"), F.lit("."), number(40, "b"), F.lit("."), number(9, "c"), F.lit("."), "ext"),
        F.concat(w[0], number(100, "g"), F.lit("."), w[1], F.lit("."), "top"), F.concat(w[0], F.lit("_"), number(10000, "h"), F.lit("_v"), number(9, "i")),
        F.concat(w[0], F.lit("="), w[1], F.lit("_"), w[2], F.lit("="), number(1000, "j")),
        F.concat(F.concat_ws("-", *date), F.lit("-"), w[0], F.lit("-"), w[1]), F.concat(F.concat_ws("/", *date), F.lit("/"), w[0], F.lit("-"), w[1]),
        F.concat(w[0], F.lit("_"), *date, F.lit("."), "ext"), F.abs(F.xxhash64("id")).cast("string"),
        F.repeat(pick(tuple(RULES), "r"), 40)]
    return words.select(F.explode(F.array(*shapes)).alias("token"))


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token): the distinct words in lower case, or with a capital, that stand alone in runs too short to be scored."""
    runs = F.filter(F.array_distinct(F.split(text, RUN, -1)), lambda x: x.rlike(WORD))
    return docs.select(F.explode(F.transform(runs, lambda x: F.rtrim(x, F.lit(".")))).alias("token")).distinct()


def _samples_by_part(docs: DataFrame, text: str, n_random: int = RANDOM_SAMPLES) -> DataFrame:
    """(token, is_secret, part): part 0 random strings, 1 generated identifiers, 2 words of ``docs``."""
    spark = docs.sparkSession
    parts = [(random_strings(spark, n_random), True), (ordinary_identifiers(spark), False), (corpus_words(docs, text), False)]
    named = [d.select("token", F.lit(s).alias("is_secret"), F.lit(i).alias("part")) for i, (d, s) in enumerate(parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def labelled_samples(docs: DataFrame, text: str = "text", n_random: int = RANDOM_SAMPLES) -> DataFrame:
    """(token, is_secret): random strings, generated identifiers, and the words of ``docs``, each once.

    No sample is taken from a string that is itself scored, so what is looked
    for cannot teach the ordinary model, however often it is repeated.
    """
    return _samples_by_part(docs, text, n_random).drop("part")


def _code(token: Column, i: Column) -> Column:
    return F.ascii(F.substring(token, i, 1))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition: entry 128 * from + to, of 16,384.

    Only transition counts (at most 128 x 128 numbers for each class and part) come
    to the driver. If there is a column part, no part of a class weighs more than
    the class's first, so a large corpus does not outweigh the generated samples.
    """
    part = F.col("part") if "part" in samples.columns else F.lit(0)
    counts = (samples.where(F.length("token") > 1)
              .select("is_secret", part.alias("part"), "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
              .select("is_secret", "part", (_code(F.col("token"), F.col("i")) % 128 * 128 + _code(F.col("token"), F.col("i") + 1) % 128).alias("t"))
              .groupBy("is_secret", "part", "t").count().collect())
    mass = {}
    for r in counts:
        mass[r["is_secret"], r["part"]] = mass.get((r["is_secret"], r["part"]), 0) + r["count"]
    first_part = {s: min(p for c, p in mass if c == s) for s in {c for c, _ in mass}}
    weight = {(s, p): min(1.0, mass[s, first_part[s]] / m) for (s, p), m in mass.items()}
    pair = {True: [0] * 16384, False: [0] * 16384}
    first = {True: [0] * 128, False: [0] * 128}
    second = {True: [0] * 128, False: [0] * 128}
    for r in counts:
        n = r["count"] * weight[r["is_secret"], r["part"]]
        pair[r["is_secret"]][r["t"]] += n
        first[r["is_secret"]][r["t"] // 128] += n
        second[r["is_secret"]][r["t"] % 128] += n
    total = {s: sum(second[s]) for s in (True, False)}

    def log_p(s: bool, t: int) -> float:
        """Transition probability, drawn towards that of the character alone where the first one is rare."""
        alone = (second[s][t % 128] + SMOOTH) / (total[s] + SMOOTH * ALPHABET)
        return math.log((pair[s][t] + BACK_OFF * alone) / (first[s][t // 128] + BACK_OFF))

    return [log_p(True, t) - log_p(False, t) for t in range(16384)]


def _llr(token: Column, model: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
                       lambda acc, i: acc + F.get(model, _code(token, i) % 128 * 128 + _code(token, i + 1) % 128))


def find_secrets(docs: DataFrame, text: str = "text", samples: DataFrame | None = None,
                 min_llr: float = MIN_LLR) -> DataFrame:
    """``docs`` plus ``spans``: array of (start, kind, end) by start, kind, end; kind indexes ``KINDS``.

    Base spans are all kept, overlapping ones of different kinds included; a
    markov span is added where no base span overlaps the token. Null and empty
    texts have no spans. An input column called spans is replaced.
    """
    docs = docs.drop("spans")
    llr = literal_array(train(_samples_by_part(docs, text) if samples is None else samples), "double")
    out, names = _base_spans(docs, text)
    base, markov = fresh(out, "base", "markov")
    t = F.coalesce(F.col(text), F.lit(""))
    scored = F.filter(_matches(t, TOKEN, 3, 0, 0), lambda s: _llr(
        F.substring(t, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), llr) > F.lit(float(min_llr)))
    out = out.withColumn(markov, F.when(t.rlike(TOKEN), scored).otherwise(F.array().cast(SPAN)))
    out = out.withColumn(base, F.concat(*names))
    added = F.filter(markov, lambda s: ~_overlaps(F.col(base), s))
    return out.select(*docs.columns, F.array_sort(F.concat(F.col(base), added)).alias("spans"))


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span replaced by ``mark``; overlapping spans are replaced together."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))).otherwise(text)


def secrets_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts by kind, digest of the base spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))

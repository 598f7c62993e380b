"""Secret scan: fixed forms, and strings that look random under two character Markov models. DataFrame functions only.

Two first-order models over the characters of ALPHABET are counted from labelled samples: random strings (digests of a
running number, written in hex, base 64 and capitals with digits) and ordinary identifiers (words of a sample
of about SAMPLE_DOCS documents, whatever the size of the table, alone and joined as identifiers are, and plain numbers). A run of at least LEAST_RUN such
characters is a secret if the mean log-likelihood ratio of its transitions exceeds LEAST_MEAN and their sum LEAST_SUM.
Runs are looked for between the fixed forms.

Spans are in characters, end exclusive. Positions come from splitting a text at a pattern's matches and adding up the
lengths of the pieces, so no text is walked in Python.

Cases: a null text counts as empty; without spans the strings are empty; rows are independent, so repeated rows and
keys don't matter; an empty table gives an empty table and a model of priors; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Fixed forms, by kind in order: pattern, which group is measured, characters it needs at least.
FORMS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Characters that join parts of a string; transitions to and from them tell nothing.
JOINTS = "_-="
RUN = r"[A-Za-z0-9+/_=-]"
#: Text of any fixed form that is long enough.
FIXED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"""
LEAST_RUN = 16
LEAST_MEAN, LEAST_SUM = 1.8, 25.0
#: Of the models' sample: documents, about; words of each, so that a long one doesn't outweigh the rest; strings of each random kind.
SAMPLE_DOCS, SAMPLE_WORDS = 1000, 400
SAMPLE_STRINGS = 3000
#: Matches that are folded into spans at once: folding copies what it has, so long lists go in runs.
FOLDED = 128
_SIDE = len(ALPHABET) + 1


def _codes(token: Column) -> Column:
    """Each character's place in ALPHABET, 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _transitions(token: Column) -> Column:
    """Of each pair of neighbouring characters, its cell in a table of _SIDE rows."""
    codes = _codes(token)
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * _SIDE + b)


def labelled_samples(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """token and random (true or false): generated random strings, and words and identifiers of a bounded sample."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    size = (20 + F.pmod(F.xxhash64("id"), F.lit(21))).cast("int")
    random = spark.range(SAMPLE_STRINGS).select(
        F.explode(F.array(F.substr(digest, F.lit(1), size), F.substr(base64, F.lit(1), size), F.substr(F.regexp_replace(F.upper(F.substr(base64, F.lit(30))), "[+/]", "7"), F.lit(1), size))).alias("token")
    )
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))  # by a hash of key and text, so nothing is sorted or gathered; repeats count once
    hashed = docs.select(F.xxhash64(F.col(quoted(key)), F.col(quoted(text))).alias("h"), F.col(quoted(text)).cast("string").alias("text")).where("text is not null")
    sample = hashed.where(F.pmod("h", F.lit(2**31)) < int(share * 2**31)).dropDuplicates(["h"])
    words = F.filter(F.split("text", r"[^\p{L}\p{Nd}]+"), lambda w: (F.length(w) > 0) & ~w.rlike("[0-9a-f]{16}|AKIA[A-Z0-9]{14}"))
    words = F.slice(words, 1, SAMPLE_WORDS)
    pairs = F.zip_with(words, F.slice(words, 2, SAMPLE_WORDS), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit("_"), b)))
    camel = F.zip_with(words, F.slice(words, 2, SAMPLE_WORDS), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.initcap(b))))
    upper = F.transform(pairs, lambda x: F.upper(F.regexp_replace(x, "_", "-")))
    plain = sample.select(F.explode(F.concat(words, words, pairs, camel, upper)).alias("token"))
    numbers = spark.range(SAMPLE_STRINGS).select(F.format_string("%d", F.pmod(F.xxhash64("id"), F.pow(F.lit(10), 2 + F.col("id") % 15).cast("long"))).alias("token"))
    ordinary = plain.unionAll(numbers).where("token is not null")
    return random.select("token", F.lit(True).alias("random")).unionAll(ordinary.select("token", F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of every transition, random against ordinary, as a table in row order."""
    from math import log

    cells = samples.select("random", F.explode(_transitions(F.col("token"))).alias("cell")).groupBy("random", "cell").count().collect()  # at most 2 * _SIDE ** 2 rows
    counts = [[0.5] * _SIDE**2 for _ in range(2)]
    for x in cells:
        counts[x["random"]][x["cell"]] += x["count"]
    table = []
    for row in range(_SIDE):
        ordinary, random = (c[row * _SIDE : (row + 1) * _SIDE] for c in counts)
        table += [log(r / sum(random)) - log(o / sum(ordinary)) for r, o in zip(random, ordinary, strict=True)]
    joints = {0, *(ALPHABET.index(c) + 1 for c in JOINTS)}
    return [0.0 if {k // _SIDE, k % _SIDE} & joints else x for k, x in enumerate(table)]


_SPANS = "array<struct<from: bigint, order: int, until: bigint, kind: string, found: string>>"


def _folded(pairs: Column, empty: str, one) -> Column:
    """Of matches m and the gaps before them: what one(start, end, match, gap) gives for each, in order; start and end are the match's."""
    # A one-element array binds the matches, else each run would search the text anew.
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLDED).cast("int")), lambda k: F.slice(all_, k * FOLDED + 1, F.lit(FOLDED)))
    runs = F.transform(F.array(pairs), cut)[0]

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one(start, end, x["m"], x["gap"]))).alias("out"))

    def run(acc: Column, pairs_: Column) -> Column:
        inner = F.aggregate(pairs_, F.struct(acc["at"].alias("at"), F.array().cast(empty).alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    return F.aggregate(runs, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{empty}>").alias("out")), run, lambda acc: F.flatten(acc["out"]))


def _pairs(text: Column, pattern: str) -> Column:
    """The matches m of a pattern, each with the gap before it; the last gap has an empty match."""
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))


def _spans(text: Column, kind: str, order: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Structs (from, order, until, kind, found) of the matches of a pattern whose group has at least so many characters."""
    one = lambda start, end, m, _: F.struct(start.alias("from"), F.lit(order).alias("order"), end.alias("until"), F.lit(kind).alias("kind"), m.alias("found"))
    walked = F.filter(_folded(_pairs(text, pattern), _SPANS, one), lambda s: s["found"] != "")
    if group:
        walked = F.filter(walked, lambda s: F.length(F.regexp_extract(s["found"], pattern, group)) >= least)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_SPANS))


def _between(text: Column) -> Column:
    """The runs of the text between the fixed forms, as _spans has them."""
    pattern = RUN + "{%d,}" % LEAST_RUN
    gaps = _folded(_pairs(text, FIXED), "array<struct<at: bigint, text: string>>", lambda start, _, __, gap: F.struct((start - F.length(gap)).alias("at"), gap.alias("text")))
    moved = lambda gap: F.transform(
        _spans(gap["text"], "markov", len(FORMS), pattern),
        lambda s: F.struct((s["from"] + gap["at"]).alias("from"), s["order"].alias("order"), (s["until"] + gap["at"]).alias("until"), s["kind"].alias("kind"), s["found"].alias("found")),
    )
    inside = F.flatten(F.transform(F.filter(gaps, lambda g: F.length(g["text"]) >= LEAST_RUN), moved))
    return F.when(~text.rlike(pattern), F.array().cast(_SPANS)).when(text.rlike(FIXED), inside).otherwise(_spans(text, "markov", len(FORMS), pattern))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["until"].cast("string"))), ",")


def scanned(docs: DataFrame, table: list[float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, base (array of spans of the fixed forms) and spans (those and the model's) of every row."""
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    step = docs.select(F.col(quoted(key)).alias("key"), whole.alias("text"))
    step = step.select("key", "text", F.sort_array(F.concat(*(_spans(F.col("text"), kind, k, pattern, group, least) for k, (kind, pattern, group, least) in enumerate(FORMS)))).alias("base"))
    step = step.select("key", "base", _between(F.col("text")).alias("runs"))

    def random(s: Column) -> Column:
        score = F.aggregate(_transitions(s["found"]), F.lit(0.0), lambda total, cell: total + F.get(ratios, cell))
        return (score >= LEAST_SUM) & (score >= LEAST_MEAN * (F.length(s["found"]) - 1))

    return step.select(F.col("key").alias(key), "base", F.sort_array(F.concat("base", F.filter("runs", random))).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the fixed forms' spans, and all spans as text."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *(number(kind) for kind, *_ in FORMS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))

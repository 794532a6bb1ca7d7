"""Secret scans with character Markov models (native).

Base rules find assignments to secret-like names, access ids and long
hexadecimal runs. Beside them, every token of 20 or more characters of the
base-64 alphabets is scored: the log-likelihood ratio of its character bigrams
under a model of random strings and one of ordinary identifiers. Both models
are smoothed bigram counts over distinct labelled samples: strings made by rule,
and, from a bounded sample of the corpus, the long values that base rules find
against the long words outside them. The kinds are independent: a token judged
random is reported whether or not a base span covers it, which tells a random
value of an assignment from a placeholder; base spans always stay.

Defined cases: a null text is an empty one and has no spans; ties are ordered by
start, then kind; repeated rows get equal spans; an empty table gives an empty
result, and a model of the strings made by rule alone; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import drawn_unit
from textquarry.llm.spans import chars, match_spans

#: The patterns of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0 stands before the first character
THRESHOLD = 10.0
#: Documents, on average, that the corpus sample holds at most; tokens of this many characters count as long words in it.
SAMPLE_DOCS = 4000
LONG = r"[A-Za-z0-9+/_=-]{10,}+"
#: Parts of ordinary identifiers.
PARTS = (
    "get set add new old max min num all any user name item list file path line data time date size type code text word page host port node edge tree hash key "
    "value index count total start stop begin end first last next prev left right input output read write open close load save build parse token string number "
    "buffer stream table column row query result filter group order limit offset config option default error message handler request response client server "
    "session connection manager factory service controller document collection language version update delete create insert select format window context "
    "the and for with from this that not tion ing er est ment ation able ness ent schaft lich keit ung heit ous eur ique cion ado dad mente"
).split()


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """text, is_random: strings made by rule, half random (hexadecimal, base 64, lower case with digits), half compound identifiers."""
    ids = spark.range(0, rows, numPartitions=4)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.regexp_replace(raw, "[=+/]", "")).when(F.col("id") % 4 == 2, raw).otherwise(F.translate(F.regexp_replace(raw, "[=+/]", ""), ALPHABET[26:52], ALPHABET[:26]))
    words = F.array(*[F.lit(w) for w in PARTS])

    def part(n: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(len(PARTS))) + 1).cast("int"))

    parts = [part(n) for n in range(4)]
    camel = F.concat(parts[0], *[F.initcap(p) for p in parts[1:]])
    styles = [F.concat(*parts), F.concat_ws("_", *parts), camel, F.concat_ws("-", *parts), F.upper(F.concat_ws("_", *parts)), F.concat_ws("/", *parts)]
    ordinary = styles[0]
    for i, style in enumerate(styles[1:], 1):
        ordinary = F.when(F.col("id") % len(styles) == i, style).otherwise(ordinary)
    return ids.select(random.alias("text"), F.lit(True).alias("is_random")).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("is_random")))


def corpus_samples(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """text, is_random: of about `most` documents at most, drawn by hash, the long values that base rules find and the long words outside them."""
    share = most / max(1, docs.count())
    some = docs.filter(drawn_unit("doc_id", F.lit("secrets")) < share).select(F.col("text").cast("string").alias("text")).filter("text is not null")

    def all_of(text: Column, pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    values = F.concat(all_of(F.col("text"), ASSIGN, 2), all_of(F.col("text"), ACCESS), all_of(F.col("text"), HEX))
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    secret = some.select(F.explode(F.filter(values, lambda v: F.length(v) >= 20)).alias("text"), F.lit(True).alias("is_random"))
    return secret.unionByName(some.select(F.explode(all_of(rest, LONG)).alias("text"), F.lit(False).alias("is_random")))


def bigrams(token: Column) -> Column:
    """Codes (before * STATES + after) of a token's character pairs, the start among them."""
    letters = chars(token)
    states = F.concat(F.array(F.lit(0)), F.transform(letters, lambda c: F.call_function("locate", c, F.lit(ALPHABET))))
    return F.zip_with(F.slice(states, 1, F.size(states) - 1), F.slice(states, 2, F.size(states) - 1), lambda a, b: a * STATES + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) by bigram code; at most STATES squared counts come to the driver."""
    pairs = samples.filter("text is not null and text <> ''").distinct().select("is_random", F.explode(bigrams(F.col("text"))).alias("code"))
    counts = {(r["is_random"], r["code"]): r["n"] for r in pairs.groupBy("is_random", "code").agg(F.count("*").alias("n")).collect()}
    out = [0.0] * (STATES * STATES)
    for a in range(STATES):
        totals = {kind: sum(counts.get((kind, a * STATES + b), 0) for b in range(STATES)) for kind in (True, False)}
        for b in range(STATES):
            p, q = (math.log((counts.get((kind, a * STATES + b), 0) + 0.5) / (totals[kind] + 0.5 * STATES)) for kind in (True, False))
            out[a * STATES + b] = p - q
    return out


def ratio(token: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to one literal
    return F.aggregate(bigrams(token), F.lit(0.0), lambda acc, code: acc + F.element_at(table, code + 1))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans, array<struct<start, kind_no, end, value>> in order of start and kind."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id", match_spans(text, ASSIGN, 2, 6).alias("assign"), match_spans(text, ACCESS).alias("access"), match_spans(text, HEX).alias("hex"), match_spans(text, TOKEN).alias("tokens")
    )

    def tagged(column: str, no: int) -> Column:
        return F.transform(F.col(column), lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), s["value"].alias("value")))

    found = found.withColumn("base", F.concat(tagged("assign", 0), tagged("access", 1), tagged("hex", 2)))
    scored = F.filter(F.col("tokens"), lambda t: ratio(t["value"], model) > threshold)
    found = found.withColumn("markov", F.when(F.size("tokens") > 0, scored).otherwise(F.col("tokens")))
    return found.select("doc_id", F.array_sort(F.concat(F.col("base"), tagged("markov", 3))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

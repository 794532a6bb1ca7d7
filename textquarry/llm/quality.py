"""Quality rules as a learned decision list.

Statistics of whole texts feed an ordered list of rejecting rules. Each rule is
a conjunction of thresholds, grown on two thirds of a labelled sample by
information gain and pruned on the last third; the rows it covers leave the
sample before the next one is sought (sequential covering). A rule counts only
if it is precise on both parts, so that clean documents stay. The list is
emitted as one Spark conditional expression. The sample is bounded
(SAMPLE_ROWS labelled documents, by hash order); statistics and verdicts cover
all rows.

Defined cases: null and blank texts have no words and fail the base rule (under
50 words); ties in gain go to the first feature and the lower threshold; without
labelled rows of both kinds the list is empty and only the base rule rejects;
repeated rows get equal verdicts; extra columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 6000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_digits", "n_wide")
#: Features of the rules: ratios of the counts, so that they do not depend on length alone.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "capital_rate": ("n_capitals", "word_chars"),
    "mark_rate": ("n_marks", "n_words"),
    "digit_rate": ("n_digits", "word_chars"),
    "line_length": ("n_words", "n_lines"),
    "wide_rate": ("n_wide", "word_chars"),
}
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    ids: dict = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n)
    twice = np.bincount(coded)[coded] > 1
    hit = np.zeros(n + 2, bool)
    for shift in range(3):
        hit[shift : n + shift] |= twice
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    return (
        len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(raw) - len(raw.translate(None, CAPITALS)), raw.count(b"!") + raw.count(b"?"), len(raw) - len(raw.translate(None, DIGITS)), len(raw) - len(text),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x.as_py()) for x in batch.column("__text")]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in COUNTS]
        at = batch.schema.get_field_index("__text")
        kept = batch.remove_column(at)
        yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*kept.schema.names, *[f"__{c}" for c in COUNTS]])


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and, prefixed with __, the counts of its text."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(f"__{c}", T.LongType()) for c in COUNTS]
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(_count_batches, T.StructType(fields))


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.coalesce(F.col(f"__{over}") / F.when(F.col(f"__{under}") > 0, F.col(f"__{under}")), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("__n_words") < 50) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 50)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        return feature(self.name) > self.limit if self.above else feature(self.name) <= self.limit

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.limit if self.above else x[self.name] <= self.limit


def covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(x), rule, np.ones(n, bool))


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold with the most information gain for the rows still inside the rule."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for name in FEATURES:
        values = x[name][inside]
        order = np.argsort(values, kind="stable")
        values, is_bad = values[order], bad[inside][order]
        cuts = np.flatnonzero(np.diff(values) > 0)
        if not len(cuts):
            continue
        low_p = np.cumsum(is_bad)[cuts].astype(float)
        low_n = (cuts + 1) - low_p
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = gain[i], Condition(name, above, float((values[cuts[i]] + values[cuts[i] + 1]) / 2))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 3, longest: int = 4, most_rules: int = 24) -> list[list[Condition]]:
    """Rules in order; a row that one of them covers is rejected."""
    n, rules = len(bad), []
    left = np.ones(n, bool)
    prune_part = np.arange(n) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~prune_part).sum() >= least:
        rule: list[Condition] = []
        while len(rule) < longest:
            inside = left & ~prune_part & covered(rule, x, n)
            if not (bad & inside).any() or not (~bad & inside).any():
                break
            if (found := best_condition(x, bad, inside)) is None:
                break
            rule.append(found)

        def worth(r: list[Condition]) -> float:
            c = left & prune_part & covered(r, x, n)
            p = int((bad & c).sum())
            m = int((~bad & c).sum())
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        c = left & covered(rule, x, n)
        p, m = int((bad & c).sum()), int((~bad & c).sum())
        if not rule or p < least or p < precision * (p + m) or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~c
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """True for rows that no rule rejects."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """The decision list learned from at most `rows` labelled documents."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__quality"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # the sample has at most `rows` rows of 12 bytes
    some = docs.select("doc_id", "text").join(F.broadcast(known), docs["doc_id"] == known["__id"]).select(F.col("__id"), "__quality", "text")
    got = with_counts(some, ["__id", "__quality"]).filter(~base_failed()).select("__id", "__quality", *[feature(f).alias(f) for f in FEATURES])
    sample = got.orderBy(F.xxhash64("__id"), "__id", *FEATURES).limit(rows).toPandas()
    return learn({f: sample[f].to_numpy(float) for f in FEATURES}, sample["__quality"].to_numpy() == 0) if len(sample) else []


def judge(docs: DataFrame, rules: list[list[Condition]], keep: list[str]) -> DataFrame:
    """The columns `keep`, the counts (prefixed with __), __base_failed and __kept."""
    counted = with_counts(docs, keep).withColumn("__base_failed", base_failed())
    return counted.withColumn("__kept", ~F.col("__base_failed") & as_column(rules))

"""Language identification with a string kernel.

Two texts are as similar as the share of distinct character n-grams (n = 1 to
ORDERS, hashed) that they have in common: k(x, y) = |x & y| / sqrt(|x| |y|). A
bounded sample is compared with LANDMARKS of its own texts; the Nystroem map
turns these values into features, and one ridge regression per language against
all others is solved on them. As k is linear in the presence of n-grams, the
landmarks and weights fold into one matrix (n-grams x languages), and a batch of
texts is scored by one matrix product.

The sample is bounded: at most PER_LANGUAGE documents of each language, by hash
order. Predictions cover all documents and use nothing but their text.

Defined cases: a null text or one without letters is `und` with score 0, and so
is everything if no labelled document with letters is there; ties go to the first
language by name; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_LANGUAGE = 600
LANDMARKS = 160
ORDERS = 4
BITS = 15
RIDGE = 1e-2
BATCH = 128
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:])))


def presence(text: str, bits: int = BITS) -> np.ndarray:
    """Which hashed n-grams of the lower-cased text occur; digits and marks count as blanks."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # letters keep their code, all else below 0xAA is a blank; blanks in a row are one
    letter = ((code >= 97) & (code <= 122)) | (code >= 0xAA)
    code = np.where(letter, code, np.uint32(32))
    code = code[np.concatenate([[True], ~((code[1:] == 32) & (code[:-1] == 32))])] if len(code) else code
    out = np.zeros(1 << bits, bool)
    state = np.zeros(len(code), np.uint32)
    for n in range(ORDERS):
        if len(code) <= n:
            break
        state = (state[: len(code) - n] + code[n:]) * _FACTORS[n]
        state ^= state >> np.uint32(15)
        out[(state * _FACTORS[4]) >> np.uint32(32 - bits)] = True
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # n-grams x languages
    bias: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.weights.shape[0]), np.float32)
        for i, text in enumerate(texts):
            rows[i] = presence(text)
        rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return rows @ self.weights + self.bias


def kernel_model(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem map over evenly taken landmarks, then one-versus-rest kernel ridge regression."""
    names = sorted(set(languages))

    def unit(part: np.ndarray) -> np.ndarray:
        return part.astype(np.float32) / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True, dtype=np.float32), 1))

    order = np.argsort(np.array(languages), kind="stable")  # every language gives its share of landmarks
    chosen = order[np.unique(np.linspace(0, len(order) - 1, min(landmarks, len(order))).astype(int))]
    marks = unit(rows[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    blocks = [unit(rows[i : i + BATCH]) @ marks.T for i in range(0, len(rows), BATCH)]
    features = np.concatenate(blocks).astype(np.float64) @ project
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # every language weighs as much as any other
    weight = np.array([1.0 / languages.count(x) for x in languages])
    weight *= len(languages) / weight.sum()
    mean, aim = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    centred = (features - mean) * np.sqrt(weight)[:, None]
    gram = centred.T @ centred + ridge * len(languages) * np.eye(features.shape[1]) / 100
    solved = np.linalg.solve(gram, centred.T @ ((target - aim) * np.sqrt(weight)[:, None]))
    return Model(names, (marks.T @ (project @ solved)).astype(np.float32), (aim - mean @ solved).astype(np.float32))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from docs (doc_id, text, lang); every row given may be used."""
    known = docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 30)).alias("draw"))
    # one number per language, as the model itself has; a thinned set first, so that little text is shuffled
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2.0 * per_language + 100) / n))])
    some = known.filter(F.col("draw") < F.element_at(share, F.col("lang")) * (1 << 30))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("place") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            packed = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], names=["lang", "seen"])

    rows = sorted((r["lang"], bytes(r["seen"])) for r in some.select("lang", "text").mapInArrow(run, "lang string, seen binary").filter("seen is not null").collect())
    if not rows:
        return None
    seen = np.unpackbits(np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return kernel_model(seen, [x for x, _ in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep`, __lang and __score (the share of the best language after a softmax)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            use = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for at in range(0, len(use), BATCH):
                who = use[at : at + BATCH]
                got = model.score([texts[i] for i in who]).astype(np.float64)
                share = np.exp(4 * (got - got.max(axis=1, keepdims=True)))
                scores[who] = (share / share.sum(axis=1, keepdims=True)).max(axis=1)
                for i, best in zip(who, got.argmax(axis=1), strict=True):
                    names[i] = model.languages[best]
            kept = batch.remove_column(batch.schema.get_field_index("__text"))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept.schema.names, "__lang", "__score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)

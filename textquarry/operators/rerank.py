"""Second-stage scores: min-max normalised reranker logits, blended with the first ranking by position."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import truncated
from textquarry.operators.lexical import top_rows

CANDIDATES = 30
NEUTRAL = 0.5
#: Fixed values: (last 0-based rank of the band, weight of the first ranking); the rest weighs the reranker.
BANDS = ((2, 0.75), (9, 0.60), (None, 0.40))


class Reranker(Protocol):
    """Scores texts against one query; sent to the workers, so it must pickle."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class OverlapReranker:
    """Counts query words in the text; for tests and offline use."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [float(sum(w in wanted for w in t.lower().split())) for t in texts]


def with_logits(hits: DataFrame, reranker: Reranker, text: str = "snippet", top: int = CANDIDATES, strict: bool = True) -> DataFrame:
    """Adds logit to the first `top` hits of each query; their texts are cut first.

    Unless strict, a reranker that fails gives no logits, and the first ranking stands.
    """

    @F.pandas_udf(T.DoubleType())
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(index=texts.index, dtype=float)
        for query, part in texts.fillna("").groupby(queries):
            try:
                scores = reranker.score(query, part.tolist())
                if len(scores) != len(part):
                    raise ValueError("the reranker's answer does not fit the request")
                out[part.index] = scores
            except Exception:
                if strict:
                    raise
        return out

    return hits.withColumn("logit", F.when(F.col("rank") <= top, run(F.col("query"), truncated(F.col(text)))))


def normalised(hits: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """Adds rerank_score in 0..1: min-max over the first `top` hits of a query, 0.5 where all are equal and beyond."""
    per_query = Window.partitionBy("query_id")
    inside = F.when((F.col("rank") <= top) & ~F.isnan("logit"), F.col("logit"))
    low, high = F.min(inside).over(per_query), F.max(inside).over(per_query)
    score = F.when(inside.isNull() | (high == low), NEUTRAL).otherwise((F.col("logit") - low) / F.when(high != low, high - low))
    return hits.withColumn("rerank_score", score)


def reranked(hits: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """By rerank_score, ties in the order of the first ranking."""
    scored = normalised(hits, top).withColumnRenamed("rank", "first_rank")
    return top_rows(scored, None, [F.desc("rerank_score"), F.col("first_rank")])


def blended(hits: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """By a mix of first rank and rerank_score whose weights depend on the first rank."""
    scored = normalised(hits, top)
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = F.col("rank") - 1
    share = F.when(n > 1, 1.0 - place / F.when(n > 1, n - 1)).otherwise(1.0)
    weight = F.lit(BANDS[-1][1])
    for last, own in reversed(BANDS[:-1]):
        weight = F.when(place <= last, own).otherwise(weight)
    mixed = scored.withColumn("blended_score", weight * share + (1.0 - weight) * F.col("rerank_score")).withColumnRenamed("rank", "first_rank")
    return top_rows(mixed, None, [F.desc("blended_score"), F.col("first_rank")])

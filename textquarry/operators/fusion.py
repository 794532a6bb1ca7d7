"""Rank fusion: lists of hits to one ranking, with the reasons for each score.

A hit list is a DataFrame of query_id, rank (from 1), score and the columns that
identify and describe a document. All functions work on many queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.lexical import top_rows


@dataclass(frozen=True)
class FusionOptions:
    """Fixed values by default: the rank constant, the bonuses for top ranks and the floor under the best score."""

    k: int = 60
    bonus_first: float = 0.05
    bonus_second_third: float = 0.02
    floor: float = 0.4


DEFAULTS = FusionOptions()
KEY = ("collection", "path")
FIRST_LIST_BONUS = 1.0


def merge_lists(lists: list[DataFrame], bonus: float = FIRST_LIST_BONUS, k: int = DEFAULTS.k, key: tuple[str, ...] = KEY) -> DataFrame | None:
    """One list out of several: weighted reciprocal ranks, the first list weighing 1 + bonus.

    A single list keeps its own scores. What describes a document comes from
    the list that ranks it best, the earlier one on a tie.
    """
    if len(lists) < 2:
        return lists[0] if lists else None
    rest = [c for c in lists[0].columns if c not in ("query_id", "rank", "score", *key)]
    tagged = None
    for number, rows in enumerate(lists):
        one = rows.select("query_id", *key, "rank", F.struct(*rest).alias("shown") if rest else F.lit(1).alias("shown"), F.lit(number).alias("list_no"))
        tagged = one if tagged is None else tagged.unionByName(one)
    weight = F.when(F.col("list_no") == 0, 1.0 + bonus).otherwise(1.0)
    merged = tagged.groupBy("query_id", *key).agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.min_by("shown", F.struct("rank", "list_no")).alias("shown"))
    flat = merged.select("query_id", *key, "score", *([F.col(f"shown.{c}").alias(c) for c in rest]))
    return top_rows(flat, None, [F.desc("score"), *[F.col(c) for c in key]])


def fuse(lexical: DataFrame, vector: DataFrame, options: FusionOptions = DEFAULTS, key: tuple[str, ...] = KEY) -> DataFrame:
    """Reciprocal rank fusion of two lists, with bonus, floor and trace.

    Columns: query_id, the key, fused_score, rank, bm25_rank, bm25_score,
    vec_rank, vec_score, rrf_only, bonus, floor, and what describes the document
    (from the lexical side where it has the document).
    """
    rest = [c for c in lexical.columns if c in vector.columns and c not in ("query_id", "rank", "score", *key)]

    def side(rows: DataFrame, number: int) -> DataFrame:
        return rows.select("query_id", *key, F.lit(number).alias("side"), "rank", "score", F.struct(F.lit(number).alias("__side"), *rest).alias("shown"))

    both = side(lexical, 0).unionByName(side(vector, 1))
    is_lexical = F.col("side") == 0
    fused = both.groupBy("query_id", *key).agg(
        F.min(F.when(is_lexical, F.col("rank"))).alias("bm25_rank"), F.max(F.when(is_lexical, F.col("score"))).alias("bm25_score"),
        F.min(F.when(~is_lexical, F.col("rank"))).alias("vec_rank"), F.max(F.when(~is_lexical, F.col("score"))).alias("vec_score"),
        F.sum(1.0 / (options.k + F.col("rank"))).alias("rrf_only"), F.min_by("shown", "side").alias("shown"),
    )
    best = F.least(F.coalesce("bm25_rank", F.lit(1 << 30)), F.coalesce("vec_rank", F.lit(1 << 30)))
    bonus = F.when(best == 1, options.bonus_first).when(best <= 3, options.bonus_second_third).otherwise(0.0)
    fused = fused.withColumn("bonus", bonus).withColumn("fused_score", F.col("rrf_only") + F.col("bonus"))
    fused = fused.withColumn("floor", F.max("fused_score").over(Window.partitionBy("query_id")) * options.floor).filter(F.col("fused_score") >= F.col("floor"))
    order = [F.desc("fused_score"), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last(), *[F.col(c) for c in key]]
    return top_rows(fused, None, order).select("query_id", "rank", *key, "fused_score", "bm25_rank", "bm25_score", "vec_rank", "vec_score", "rrf_only", "bonus", "floor", *[F.col(f"shown.{c}").alias(c) for c in rest])


def lexical_only(lexical: DataFrame) -> DataFrame:
    """What a hybrid search gives where there are no vectors."""
    none = F.lit(None)
    return lexical.select("*", F.col("score").alias("fused_score"), F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"), none.cast("int").alias("vec_rank"), none.cast("double").alias("vec_score"))


def explained() -> Column:
    """The trace of a fused row as JSON."""
    return F.to_json(F.struct("bm25_rank", "bm25_score", "vec_rank", "vec_score", "rrf_only", "bonus", "floor"))


def oversample(limit: int | None) -> int:
    """How deep each list goes before a fused list is cut to the limit."""
    return limit * 4 if limit else 40

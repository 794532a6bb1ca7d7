"""Ranking quality: P@k, R@k, reciprocal rank, macro averages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10)


def identifiers(hits: DataFrame) -> DataFrame:
    """query_id and retrieved: path and doc_id of each hit in turn, repeats and blanks dropped."""
    pairs = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "doc_id"))).alias("h"))
    flat = F.flatten(F.transform("h", lambda x: F.array(x["path"], x["doc_id"])))
    return pairs.select("query_id", F.array_distinct(F.filter(F.array_compact(flat), lambda x: x != "")).alias("retrieved"))


def holders(docs: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    """query_id and relevant, for every item (id, words): the paths of docs (path, terms) with these words in a row.

    No index or ranking takes part. An item without words is held by none.
    A text is looked through only for the items whose longest word it has.
    """
    by_word: dict[str, list[tuple[int, str]]] = {}
    for i, words in items:
        if words:
            by_word.setdefault(max(words, key=len), []).append((i, f" {' '.join(words)} "))
    sent = docs.sparkSession.sparkContext.broadcast(by_word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            ids, paths = [], []
            for path, terms in zip(batch.column("path").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                known = wanted.keys() & set(terms or ())
                text = f" {' '.join(terms)} " if known else ""
                found = [i for w in known for i, needle in wanted[w] if needle in text]
                ids += found
                paths += [path] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string())], names=["query_id", "path"])

    found = docs.select("path", "terms").mapInArrow(run, "query_id long, path string").groupBy("query_id").agg(F.collect_set("path").alias("relevant"))
    every = docs.sparkSession.createDataFrame([(i,) for i, _ in items], "query_id long")
    return every.join(found, "query_id", "left").select("query_id", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))


def metrics(retrieved: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Per query: p_at_k, r_at_k (not for 1) and mrr of retrieved (query_id, retrieved) by qrels (query_id, relevant)."""
    both = qrels.join(retrieved, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    good = F.transform("retrieved", lambda x: F.array_contains("relevant", x))
    first = F.array_position(good, True)

    def hits(k: int):
        return F.size(F.filter(F.slice(good, 1, k), lambda x: x))

    columns = [(hits(k) / F.lit(float(k))).alias(f"p_at_{k}") for k in cuts]
    columns += [F.coalesce(hits(k) / F.nullif(F.size("relevant").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"r_at_{k}") for k in cuts if k > 1]
    return both.select("query_id", *columns, F.when(first > 0, 1.0 / first).otherwise(0.0).alias("mrr"))


def metrics_of_pairs(retrieved: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """metrics of rows (query_id, rank, item) by rows (query_id, item); no query's relevant items are gathered in one place."""
    hits = retrieved.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    known = relevant.select("query_id", "item").distinct()
    totals = known.groupBy("query_id").agg(F.count("*").alias("all"))
    good = hits.join(known, ["query_id", "item"], "left_semi")
    found = good.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in cuts], F.min("rank").alias("first"))
    both = totals.join(found, "query_id", "left")
    inside = {k: F.coalesce(F.col(f"in_{k}"), F.lit(0)) for k in cuts}
    columns = [(inside[k] / F.lit(float(k))).alias(f"p_at_{k}") for k in cuts] + [(inside[k] / F.col("all")).alias(f"r_at_{k}") for k in cuts if k > 1]
    return both.select("query_id", *columns, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def summary(per_query: DataFrame) -> DataFrame:
    """Macro averages, to three places."""
    return per_query.agg(*[F.round(F.avg(c), 3).alias(c) for c in per_query.columns if c != "query_id"])

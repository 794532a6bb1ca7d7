"""Vector search: exact nearest neighbours with one result per document, and embedders."""

from __future__ import annotations

import math
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions import text as X
from textquarry.functions.query_syntax import split_collections
from textquarry.operators.lexical import top_rows

EMBED_BATCH = 32
#: Queries whose distances to one Arrow batch are held at a time.
QUERY_BLOCK = 256
#: How many chunks the unfiltered search takes before it looks at documents.
OVERFETCH, FETCH_LEAST, FETCH_MOST = 4, 50, 4096
DEFAULT_LIMIT = 5


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


METRICS = {"l2": l2, "cosine": cosine}


def fetch_size(limit: int, every: bool = False) -> int:
    return FETCH_MOST if every else min(max(limit * OVERFETCH, FETCH_LEAST), FETCH_MOST)


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """vectors; reading a row of another width is an error."""
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(F.raise_error(F.format_string(f"vector has %d numbers, the index {dim}", F.size(column)))))


def distances(points: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Of rows to one query, in double precision."""
    if metric == "cosine":
        return 1 - (points @ query) / (np.linalg.norm(points, axis=1) * np.linalg.norm(query))
    return np.sqrt(((points - query) ** 2).sum(axis=1))


def estimates(points: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows x queries: numbers that rise with the distance, from one matrix product, and how far they may be off, by query."""
    product = points @ queries.T
    own, other = (points**2).sum(axis=1), (queries**2).sum(axis=1)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - product / (np.sqrt(own)[:, None] * np.sqrt(other)[None, :]), np.full(len(queries), 1e-9)
    return own[:, None] - 2 * product + other[None, :], 1e-9 * (own.max() + other)


def best_rows(points: np.ndarray, query: np.ndarray, estimate: np.ndarray, slack: float, metric: str, docs: np.ndarray, tied: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best row of each of the `size` nearest documents, and the distances; ties in the order of `tied`.

    Only rows that the estimate does not rule out are measured and sorted.
    """
    take = min(len(points), 2 * size)
    while True:
        if take < len(points):
            edge = np.partition(estimate, take - 1)[take - 1]
            rows = np.flatnonzero(~(estimate > edge + 2 * slack))
        else:
            rows = np.arange(len(points))
        found = distances(points[rows], query, metric)
        order = np.lexsort((tied[rows], found))
        _, first = np.unique(docs[rows[order]], return_index=True)
        if len(first) >= size or len(rows) == len(points):
            picked = order[np.sort(first)[:size]]
            return rows[picked], found[picked]
        take = min(len(points), take * 4)


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], limit: int | None = None, metric: str = "l2", doc: str = "doc_key", chunk: str = "chunk_key") -> DataFrame:
    """query_id, rank, doc_key, chunk_key, distance and score: the best chunk of each of the nearest documents.

    Each Arrow batch keeps its own best documents per query, ties ordered by doc_key
    and chunk_key as in the final ranking: no other document of the batch can be
    among the best overall. Only these few rows are
    shuffled. The queries, a batch that the caller made, go to every task.
    """
    size = limit or DEFAULT_LIMIT
    ids = np.array([i for i, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        for batch in batches:
            rows = batch.column("embedding")
            n = batch.num_rows
            if not n:
                continue
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != n * matrix.shape[1]:
                raise ValueError(f"vectors must have {matrix.shape[1]} numbers")
            points = flat.reshape(n, -1)
            keys = pa.table({"doc": batch.column("doc_key"), "chunk": batch.column("chunk_key")})
            # places of the rows by (doc_key, chunk_key), nulls first as in the final ranking, and documents as numbers
            tied = np.empty(n, np.int64)
            tied[pc.sort_indices(keys, [("doc", "ascending"), ("chunk", "ascending")], null_placement="at_start").to_numpy()] = np.arange(n)
            docs = batch.column("doc_key").dictionary_encode("encode").indices.to_numpy()
            for at in range(0, len(ids), QUERY_BLOCK):
                block = matrix[at : at + QUERY_BLOCK]
                estimate, slack = estimates(points, block, metric)
                best = [best_rows(points, q, estimate[:, k], slack[k], metric, docs, tied, size) for k, q in enumerate(block)]
                rows = pa.array(np.concatenate([r for r, _ in best]))
                asked = np.repeat(ids[at : at + QUERY_BLOCK], [len(r) for r, _ in best])
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), batch.column("doc_key").take(rows), batch.column("chunk_key").take(rows), pa.array(np.concatenate([d for _, d in best]), pa.float64())], names=["query_id", "doc_key", "chunk_key", "distance"])

    source = vectors.select(F.col(doc).alias("doc_key"), F.col(chunk).alias("chunk_key"), "embedding")
    schema = T.StructType([T.StructField("query_id", T.LongType()), source.schema["doc_key"], source.schema["chunk_key"], T.StructField("distance", T.DoubleType())])
    return best_documents(source.mapInArrow(run, schema), size)


def best_documents(found: DataFrame, limit: int | None) -> DataFrame:
    """The best chunk of each document, then the best documents of each query."""
    best = F.min(F.struct("distance", "chunk_key"))
    by_doc = found.groupBy("query_id", "doc_key").agg(best.alias("b")).select("query_id", "doc_key", "b.chunk_key", "b.distance")
    return top_rows(by_doc, limit, [F.col("distance"), F.col("doc_key")]).withColumn("score", X.similarity(F.col("distance")))


def search(vectors: DataFrame, queries: list[tuple[int, list[float]]], docs: DataFrame, limit: int | None = None, collections: str | None = None, min_score: float = 0.0, metric: str = "l2", complete: bool = False) -> DataFrame:
    """Hits with the columns of docs; the collection filter works before the cut, so no row is lost to it.

    complete says that every vector's document is among docs: without a filter
    the vectors then need no join, and only the best rows meet their documents.
    """
    names = split_collections(collections)
    known = docs.filter(F.col("collection").isin(names)) if names else docs
    usable = vectors if complete and not names else vectors.join(known.select("doc_key"), "doc_key", "left_semi")
    top = nearest(usable, queries, limit, metric)
    return top.join(known, "doc_key").filter(F.col("score") >= min_score)


class Embedder(Protocol):
    """What an embedding backend offers; it is sent to the workers, so it must pickle."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic unit vectors from a 32-bit FNV-1a hash of the text, for tests and offline use."""

    def __init__(self, dim: int = 768, model: str = "mock-embed"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            seed = 2166136261
            for byte in text.encode():
                seed = ((seed ^ byte) * 16777619) & 0xFFFFFFFF
            values = [math.sin(seed * (i + 1)) for i in range(self.dim)]
            norm = math.sqrt(sum(v * v for v in values)) or 1.0
            out.append([v / norm for v in values])
        return out


#: Answers that are worth another try, and the most calls at a time.
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
MOST_WORKERS = 8


def worker_count(asked: int = 0) -> int:
    """Calls at a time: what was asked for, else TEXTQUARRY_WORKERS, else one; MOST_WORKERS at most."""
    return max(1, min(asked or int(os.environ.get("TEXTQUARRY_WORKERS") or 0), MOST_WORKERS))


def worth_retrying(error: Exception) -> bool:
    """Lost connections, time-outs, and answers whose `status` or `code` says busy or broken."""
    status = getattr(error, "status", None) or getattr(error, "code", None)
    return status in RETRY_STATUS if isinstance(status, int) else isinstance(error, (OSError, TimeoutError))


class RetryingEmbedder:
    """Wraps a remote call: bounded batches, several at a time, retries with growing pauses, answers back in order."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], model: str, dim: int, batch: int = 100, tries: int = 4, pause: float = 1.0, workers: int = 0):
        self.call, self.model, self.dim, self.batch, self.tries, self.pause, self.workers = call, model, dim, batch, tries, pause, worker_count(workers)

    def _answer(self, part: list[str]) -> list[list[float]]:
        for turn in range(self.tries):
            try:
                got = self.call(part)
                break
            except Exception as error:
                if turn == self.tries - 1 or not worth_retrying(error):
                    raise
                time.sleep(min(self.pause * 2**turn, 30))
        if len(got) != len(part) or any(len(v) != self.dim for v in got):
            raise ValueError("the backend's answer does not fit the request")
        return got

    def embed(self, texts: list[str]) -> list[list[float]]:
        parts = [texts[at : at + self.batch] for at in range(0, len(texts), self.batch)]
        if self.workers == 1 or len(parts) < 2:
            return [v for part in parts for v in self._answer(part)]
        with ThreadPoolExecutor(self.workers) as pool:
            return [v for got in pool.map(self._answer, parts) for v in got]


def cached_query_vector(embedder: Embedder, size: int = 32) -> Callable[[str], tuple[float, ...]]:
    """embed for single queries, with the last `size` answers kept on the driver."""

    @lru_cache(size)
    def run(text: str) -> tuple[float, ...]:
        return tuple(embedder.embed([text])[0])

    return run


def fnv_seed(text: Column) -> Column:
    """The hash that HashEmbedder starts from, in SQL functions."""
    raw = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    return F.aggregate(raw, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def embed_texts(rows: DataFrame, embedder: Embedder, text: str = "prompt", batch: int = EMBED_BATCH) -> DataFrame:
    """rows with an embedding of the column `text`; the model is set up once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [t or "" for t in part.column(text).to_pylist()]
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                out += embedder.embed(texts[at : at + batch])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False))]))


def needing_embedding(chunks: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Chunks (with text_hash) whose text no vector stands for yet."""
    return chunks if force else chunks.join(done.select("text_hash").distinct(), "text_hash", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_key") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)

"""Registered queries of formats, changes to the catalog and fallbacks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as X
from textquarry.operators import catalog, fusion, rerank, vector
from textquarry.plans.catalog_queries import _BM25, _COLLECTIONS, TERMS, _and_sql, _collections, _corpus, _docs, _search, _table, query
from textquarry.sources import sinks

#: Hits made of all documents: scores without ties in their last shown place.
_HITS = """hits AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, left(sha256(text), 6) AS doc_id, 'Doc ' || doc_id AS title, source AS collection, lang || '/' || doc_id || '.md' AS path, n_chars / 7::DOUBLE AS score,
CASE WHEN length(text) > 240 THEN left(text, 240) || '...' ELSE text END AS snippet FROM documents WHERE text IS NOT NULL)"""


def _hits(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir).filter("text is not null")
    ranked = docs.select(
        F.row_number().over(Window.orderBy("doc_id")).alias("rank"), X.short_id(X.content_hash(F.col("text"))).alias("short"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("n_chars") / F.lit(7.0)).alias("score"), X.head(F.col("text")).alias("snippet"),
    )
    # marks of a terminal, which the formats take out
    return ranked.withColumn("snippet", F.concat(F.lit("\x1b[1m"), "snippet", F.lit("\x1b[0m"))).withColumnRenamed("short", "doc_id")


def _rank() -> list:
    return [F.col("rank").cast("long").alias("rank")]


@query(f"WITH {_HITS} SELECT rank, json_object('doc_id', doc_id, 'title', title, 'path', path, 'collection', collection, 'score', score, 'snippet', snippet)::VARCHAR AS value FROM hits")
def k01_json_rows(spark, sf_dir):
    return sinks.json_rows(_hits(spark, sf_dir)).select(*_rank(), "value")


@query(f"WITH {_HITS} SELECT rank, doc_id, title, collection, path, printf('%.4f', score) AS score, snippet FROM hits")
def k02_csv_rows(spark, sf_dir):
    return sinks.csv_rows(_hits(spark, sf_dir)).select(*_rank(), "doc_id", "title", "collection", "path", "score", "snippet")


@query(f"WITH {_HITS} SELECT rank, '## ' || title || chr(10) || chr(10) || '- **Path:** ' || collection || '/' || path || chr(10) || '- **Doc:** #' || doc_id || chr(10) || '- **Score:** ' || printf('%.2f', score) || chr(10) || chr(10) || snippet || chr(10) AS value FROM hits")
def k04_markdown_rows(spark, sf_dir):
    return sinks.markdown_rows(_hits(spark, sf_dir)).select(*_rank(), "value")


@query("SELECT doc_id, sha256(text) AS plain_sha256 FROM documents")
def f27_plain_text(spark, sf_dir):
    """Colour codes put between the words, and taken out again."""
    marked = F.concat(F.lit("\x1b[1m"), F.replace("text", F.lit(" "), F.lit(" \x1b[0;31m")), F.lit("\x1b[0m"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.plain_text(marked), 256).alias("plain_sha256"))


@query(f"WITH {_COLLECTIONS} SELECT name, context FROM collections UNION ALL SELECT 'notes', 'mine'")
def d01_add_collection(spark, sf_dir):
    known = _collections(spark).select("name", F.lit("/r").alias("root"), F.lit("*").alias("glob"), "context")
    return catalog.add_collection(known, "", "/data/notes/", context="mine").select("name", "context")


@query("SELECT source AS collection, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source")
def d02_remove_collection(spark, sf_dir):
    _, docs = catalog.remove_collection("src3", _collections(spark), _corpus(spark, sf_dir))
    return docs.groupBy("collection").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CASE WHEN source = 'src3' THEN 'archive' ELSE source END AS collection, lang || '/' || doc_id || '.md' AS path FROM documents UNION ALL SELECT 'src3', lang || '/' || doc_id || '.md' FROM documents WHERE source = 'src3')
SELECT collection, count(*) AS n_docs, count(DISTINCT path) AS n_keys FROM d GROUP BY collection UNION ALL SELECT 'all', count(*), count(*) FROM (SELECT DISTINCT * FROM d)""")
def d03_rename_collection(spark, sf_dir):
    """A renamed collection beside a new one of the old name with the same paths: no two documents share a key."""
    docs = _corpus(spark, sf_dir).select("collection", "path").withColumn("doc_key", catalog.doc_key())
    _, renamed = catalog.rename_collection("src3", "archive", _collections(spark), docs)
    both = renamed.unionByName(docs.filter("collection = 'src3'"))
    each = both.groupBy("collection").agg(F.count("*").alias("n_docs"), F.count_distinct("doc_key").alias("n_keys"))
    return each.unionByName(both.agg(F.lit("all").alias("collection"), F.count("*").alias("n_docs"), F.count_distinct("doc_key").alias("n_keys")))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def v02_checked_vectors(spark, sf_dir):
    """Every row passes the check of its width, which reads it."""
    return vector.checked(_table(spark, sf_dir, "embeddings"), 64).filter(F.size("embedding") > 0).select("vec_id")


@query(f"""WITH {_BM25}, hit AS ({_and_sql(TERMS)}), r AS (SELECT row_number() OVER (ORDER BY score DESC, source, lang || '/' || doc_id || '.md') AS rank, doc_id AS doc_key, round(score, 6) AS score FROM hit JOIN documents USING (doc_id) ORDER BY rank LIMIT 10)
SELECT rank, doc_key, score AS fused_score, rank AS bm25_rank, score AS bm25_score, NULL::BIGINT AS vec_rank, NULL::DOUBLE AS vec_score FROM r""")
def x05_lexical_fallback(spark, sf_dir):
    """What a hybrid search gives where there are no vectors."""
    got = fusion.lexical_only(_search(spark, sf_dir, [(0, " ".join(TERMS))], limit=10))
    return got.select(*_rank(), "doc_key", F.round("fused_score", 6).alias("fused_score"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("bm25_score", 6).alias("bm25_score"), F.col("vec_rank").cast("long").alias("vec_rank"), "vec_score")


class _Broken:
    def score(self, query: str, texts: list[str]) -> list[float]:
        raise OSError("no answer")


@query("SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS first_rank, 0.5::DOUBLE AS rerank_score FROM lineitem")
def x13_failing_reranker(spark, sf_dir):
    """A reranker that fails gives every hit the neutral score."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    hits = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), rank.alias("rank"), F.lit("q").alias("query"), F.col("l_partkey").cast("string").alias("snippet"))
    got = rerank.blended(rerank.with_logits(hits, _Broken(), strict=False))
    return got.select("query_id", F.col("first_rank").cast("long").alias("first_rank"), "rerank_score")

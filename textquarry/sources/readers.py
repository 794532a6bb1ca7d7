"""Sources: folders of text files, parquet tables as corpora, and relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import globs

QREL_LINE = 1 << 20


def read_folder(spark: SparkSession, collection: str, root: str, glob: str = globs.DEFAULT_GLOB) -> DataFrame:
    """collection, path (relative), absolute_path, content, updated_at of the files under root that fit the glob.

    Files that cannot be read are skipped, and so count as gone. So are empty files, which Spark does not list.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    full = F.regexp_replace(F.col("path"), "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.expr(f"substring(full_path, {len(base) + 1})")
    rows = files.select(full.alias("full_path"), "modificationTime", "content").withColumn("rel", relative)
    return rows.filter(globs.matches(F.col("rel"), glob)).select(F.lit(collection).alias("collection"), F.col("rel").alias("path"), F.col("full_path").alias("absolute_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("updated_at"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of documents (doc_id, text, lang, source) as collection, path, content, doc_key."""
    return corpus_columns(spark.read.parquet(path))


def corpus_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_key"), F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant from JSON lines; blank lines and those that begin with // or # do not count.

    A malformed line, an empty query or an empty list of relevant documents is an error.
    Lines of one query are one judgement: what any of them lists is relevant.
    """
    blank = r"^[ \t\r\x0b\f]+|[ \t\r\x0b\f]+$"
    lines = spark.read.text(path).select(F.regexp_replace("value", blank, "").alias("line")).filter("line <> '' and not startswith(line, '//') and not startswith(line, '#')")
    parsed = lines.select("line", F.from_json("line", "query STRING, relevant ARRAY<STRING>", {"mode": "PERMISSIVE"}).alias("j"))
    bad = F.col("j.query").isNull() | (F.trim("j.query") == "") | F.col("j.relevant").isNull() | (F.size("j.relevant") == 0) | (F.length("line") > QREL_LINE)
    checked = parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("not a judgement: "), F.substring("line", 1, 200)))).otherwise(F.col("j.query")).alias("query"), F.col("j.relevant").alias("relevant"))
    merged = checked.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("relevant"))).alias("relevant"))
    return merged.select(F.xxhash64("query").alias("query_id"), "query", "relevant")

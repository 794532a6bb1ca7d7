"""Streaming ingest: new and changed files reach the index in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.functions import globs
from textquarry.plans.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, collection: str, root: str, glob: str = globs.DEFAULT_GLOB) -> DataFrame:
    """The files of a folder as they appear."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    full = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rows = files.select(F.lit(collection).alias("collection"), F.substring(full, len(base) + 1, 1 << 20).alias("path"), full.alias("absolute_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("updated_at"))
    return rows.filter(globs.matches(F.col("path"), glob))


def ingest(engine: Engine, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each micro-batch to the index; documents that a batch does not name stay as they are."""

    def add(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        newest = batch.groupBy("collection", "path").agg(F.max_by(F.struct("absolute_path", "content", "updated_at"), "updated_at").alias("d")).select("collection", "path", "d.*")
        engine.upsert_documents(newest.select("collection", "path", "absolute_path", "content", "updated_at"))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

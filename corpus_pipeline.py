"""From raw documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage reads what the one before it wrote. The first four return the
columns of documents; the last returns where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontam, mixing, neardup, quality, sharding
from textquarry.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from labels."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, COLUMNS).filter("__kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles are 0.8 similar."""
    return neardup.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.filter(F.size("__starts") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part of a copy counts by a draw on the doc_id."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id")).agg((F.sum("taken") / F.sum("size")).alias("__share"))
    draw = F.pmod(F.xxhash64("__id", F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    times = taken.select("__id", F.floor(F.coalesce("__share", F.lit(0.0)) + draw).cast("int").alias("__times")).filter("__times > 0")
    both = docs.join(times, docs["doc_id"].cast("long").eqNullSafe(times["__id"]))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.assign(docs)


STAGES = [
    ("quality rules", reject_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source mix", mix_sources),
    ("shards", shard),
]

#: The learned rules and the pseudorandom mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{i}")
    return docs

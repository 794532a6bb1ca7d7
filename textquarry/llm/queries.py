"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontam, language, lines, mixing, neardup, pii, quality, secrets, sharding, token_files
from textquarry.llm.common import table


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "start", "first_shard", "first_slot")


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(docs, rules, ["doc_id"]).select("doc_id", *[F.col(f"__{c}").alias(c) for c in columns], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_samples(spark).unionByName(secrets.corpus_samples(docs)))
    spans = F.col("spans")
    found = secrets.scan(docs, model)
    base = F.filter(spans, lambda s: s["kind_no"] < 3)

    def found_of(no: int, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind_no"] == no)).cast("long").alias(f"n_{kind}")

    counts = [found_of(no, kind) for no, kind in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts[:3], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"), counts[3])


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pii.pseudonymise(docs, "query-key", ["doc_id"])


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = decontam.find(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontam.hit_words()
    return got.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), size=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = language.fit(docs.filter(~language.held_out()))
    got = language.predict(docs, model, ["doc_id"])
    return got.select("doc_id", language.held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

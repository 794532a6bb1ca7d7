"""Line dedup by distinct-site spread.

Lines are hashed; a first aggregation counts each hash and keeps its lowest and
highest site hash, which rules out lines of one site exactly. The rest get a HyperLogLog sketch
of their sites, merged by aggregation. A line whose estimate is clearly over
the threshold is boilerplate; one near it gets an exact distinct count.
Boilerplate lines are removed from all documents. Over the threshold by BAND
standard errors is taken without an exact count: at a handful of sites a sketch
still holds single values of 26 bits, so it errs only where several of them collide.

A line that very many documents hold is never dealt out by its hash: such
heavy hashes, a bounded number, go to all tasks. Texts without boilerplate are
not shuffled, but for those that a bitmap of bounded size lets through.

Defined cases: lines are compared without white space at their ends; blank lines
are never removed; a null text stays null and has no lines; a null doc_id is a
document like others; a null site is a site of its own; repeated rows count once
per site, as they share it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import maybe_among, semi_joined, staged
from textquarry.llm.spans import once

MIN_SITES = 5
LOG_K = 8
#: Width of the band around the threshold, in standard errors of the sketch.
BAND = 4.0


def _lines(docs: DataFrame) -> DataFrame:
    trimmed = F.regexp_replace(F.col("line"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    rows = docs.select("doc_id", "text_hash", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "text_hash", "site", "pos", trimmed.alias("line")).filter("line <> ''").select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("line_hash"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_hash and n (uses) of the lines found on at least min_sites distinct sites."""
    total = lines.count()
    seen = lines.groupBy("line_hash").agg(F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    maybe = staged(seen.filter((F.col("n") >= min_sites) & ((F.col("low") != F.col("high")) | F.lit(min_sites <= 1))).select("line_hash", "n"), "maybe")
    some = semi_joined(lines.select("line_hash", "site"), maybe, "line_hash", total)
    spread = some.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"), F.count("*").alias("n"))
    spread = staged(spread, "spread")
    margin = 1 + BAND * 1.04 / (2 ** (LOG_K / 2)) * min_sites
    sure = spread.filter(F.col("sites") >= min_sites + margin).select("line_hash", "n")
    near = spread.filter(F.abs(F.col("sites") - min_sites) < margin).select("line_hash", "n")
    exact = semi_joined(lines.select("line_hash", "site"), near, "line_hash", total).groupBy("line_hash", "site").agg(F.count("*").alias("n"))
    exact = exact.groupBy("line_hash").agg(F.count("*").alias("sites"), F.sum("n").alias("n"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("line_hash", "n"))


def _without(parts: Column, bad: Column) -> Column:
    """parts without those at the places `bad` (from 0, rising): what stands between them, run by run."""
    bounds = F.concat(F.array(F.lit(-1)), bad, F.array(F.size(parts)))

    def run(b: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.slice(parts, F.get(b, i) + 2, F.get(b, i + 1) - F.get(b, i) - 1)))

    return once(bounds, run)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines (not blank) and n_removed."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\x00none"))).alias("site"), F.xxhash64("text").alias("text_hash"))
    lines = staged(_lines(base), "lines")
    bad = semi_joined(lines, staged(boilerplate(lines, min_sites), "boilerplate"), "line_hash", lines.count())
    marks = bad.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("bad"))
    marks = staged(marks.select(F.xxhash64("doc_id", "text_hash").alias("__key"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "bad"), "marks")
    found = maybe_among(base.withColumn("__key", F.xxhash64("doc_id", "text_hash")), F.col("__key"), marks.select("__key"), "__maybe")
    some = found.filter("__maybe").drop("__key").join(marks.drop("__key").hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    columns = ["doc_id", "text", "bad"]
    out = some.select(*columns).unionByName(found.filter("not __maybe").withColumn("bad", F.lit(None).cast("array<int>")).select(*columns))
    split = F.split("text", "\n", -1)
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    kept = F.array_join(once(split, lambda parts: _without(parts, F.col("bad"))), "\n")
    return out.select("doc_id", F.when(F.col("bad").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("bad"), F.lit(0)).cast("long").alias("n_removed"))

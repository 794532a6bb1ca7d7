"""Sharding by balanced label propagation (native).

Documents of equal text are linked. All copies of a text that start in the
same shard form a cell; each round joins the cells of a group, finds the shard
that holds most of the group and moves the others there, as far as the shard's
quota goes. A group larger than half a shard is first cut into pieces of at most
that. Unlinked documents then fill what the linked ones leave of each shard. In
the end all documents stand in one order, by shard with the linked ones in its
middle and the smallest unlinked ones at its ends, and the order is cut into
runs of equal bytes: sizes are as even as single documents allow, and cuts fall
among small unlinked documents wherever there are enough of them.

Defined cases: null texts form a group of size 8 each, as empty ones form theirs;
repeated rows are separate documents with slots of their own; an empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import buckets_for, running, staged

SHARDS = 24
ROUNDS = 3
SALTS = 16
#: Copies up to which a piece of a group is one bucket; above, the root of all documents.
MOST_ALIKE = 128


def cells(sized: DataFrame) -> DataFrame:
    """Copies of a text by first shard and salt: a hot text makes shards x SALTS rows at most."""
    return sized.groupBy("text_hash", "text_crc32", "has_text", "first", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs"))


def propagate(cell: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """cell with piece, group_docs, and label: the shard that the rounds have moved it to."""
    capacity = max(1, total // shards)
    group = ["text_hash", "text_crc32", "has_text"]
    whole = Window.partitionBy(*group)
    state = cell.withColumns({"group_docs": F.sum("docs").over(whole), "group_bytes": F.sum("bytes").over(whole)})
    state = state.withColumn("pieces", F.greatest(F.ceil(F.col("group_bytes") / F.lit(max(1, capacity // 2))), F.lit(1)).cast("long"))
    state = state.withColumn("piece", F.when(F.col("group_docs") > 1, F.pmod(F.xxhash64("first", "salt", F.lit("piece")), F.col("pieces"))).otherwise(F.lit(0).cast("long")))
    alone = state.filter("group_docs = 1").withColumn("label", F.col("first"))
    linked = staged(state.filter("group_docs > 1").withColumn("label", F.col("first")), "cells")
    for turn in range(rounds):
        members = Window.partitionBy(*group, "piece")
        seen = linked.withColumn("__held", F.sum("bytes").over(Window.partitionBy(*group, "piece", "label")))
        best = F.max(F.struct("__held", F.pmod(F.xxhash64(*group, "piece", "label"), F.lit(1 << 30)).alias("tie"), "label")).over(members)["label"]
        seen = staged(seen.withColumn("__best", best).drop("__held"), "wishes")
        load = seen.groupBy("label").agg(F.sum("bytes").alias("load"))
        wish = seen.filter("label <> __best").groupBy(F.col("__best").alias("__to")).agg(F.sum("bytes").alias("asked"))
        quota = wish.join(load, wish["__to"] == load["label"], "left").select("__to", (F.greatest(F.lit(0), capacity - F.coalesce("load", F.lit(0))) / F.col("asked")).alias("__share"))
        # one row per shard: its size is bound by the number of shards
        moved = seen.join(F.broadcast(quota), seen["__best"] == quota["__to"], "left")
        draw = F.pmod(F.xxhash64(*group, "piece", F.lit(f"turn{turn}")), F.lit(1 << 20)) / float(1 << 20)
        linked = moved.withColumn("label", F.when((F.col("label") != F.col("__best")) & (draw < F.col("__share")), F.col("__best")).otherwise(F.col("label"))).drop("__to", "__share", "__best")
    return linked.unionByName(alone.select(*linked.columns))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    has = F.col("text").isNotNull()
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), has.alias("has_text"))
    sized = staged(sized.withColumns({"first": F.pmod(F.xxhash64("doc_id", F.lit("first")), F.lit(shards)).cast("int"), "salt": F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).cast("int")}), "shard-sizes")
    n_docs, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = staged(propagate(cells(sized), total, shards, rounds), "placed")
    keys = ["text_hash", "text_crc32", "has_text", "first", "salt"]
    by_doc = sized.join(placed.select(*keys, "piece", "pieces", "group_docs", "label"), keys)
    # the unlinked documents fill what the linked ones leave of each shard; one number per shard comes to the driver
    held = {r["label"]: r["b"] for r in placed.filter("group_docs > 1").groupBy("label").agg(F.sum("bytes").alias("b")).collect()}
    gaps = [max(0.0, total / shards - held.get(s, 0)) for s in range(shards)]
    scale = max(0, total - sum(held.values())) / max(1.0, sum(gaps))
    ends = [sum(gaps[: s + 1]) * scale for s in range(shards - 1)]
    linked = by_doc.filter("group_docs > 1").withColumns({"kind": F.lit(1), "level": F.lit(0), "part": F.pmod(F.xxhash64("doc_id", F.lit("part")), F.ceil(F.col("group_docs") / F.col("pieces") / max(MOST_ALIKE, buckets_for(n_docs))))})
    alone = by_doc.filter("group_docs = 1").withColumns({"kind": F.when(F.pmod(F.xxhash64("doc_id", F.lit("side")), F.lit(2)) == 0, 0).otherwise(2), "part": F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(buckets_for(n_docs)))})
    alone = running(alone, [], ["part"], [F.col("doc_id"), F.col("text_hash")], {"__before": F.col("size")})
    alone = alone.withColumn("label", F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= F.col("__before") + F.col("size") / 2)))
    # small documents stand next to the cuts, so that cuts are fine
    level = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    alone = alone.withColumn("level", F.when(F.col("kind") == 0, level).otherwise(-level)).drop("__before")
    subs = buckets_for(n_docs, shards)
    # groups stay together in one `sub`; documents without a group are spread by `part` already
    sub = F.when(F.col("kind") == 1, F.pmod(F.xxhash64("text_hash", "piece"), F.lit(subs))).otherwise(F.lit(0).cast("long"))
    columns = ["doc_id", "size", "text_crc32", "text_hash", "label", "kind", "level", "part", sub.alias("sub")]
    by_doc = linked.select(*columns).unionByName(alone.select(*columns))
    signed = F.when(F.col("kind") == 0, F.col("size")).when(F.col("kind") == 2, -F.col("size"))
    order = [signed, F.col("text_hash"), F.col("text_crc32"), F.col("doc_id")]
    lined = running(by_doc, [], ["label", "kind", "level", "sub", "part"], order, {"__bytes": F.col("size"), "__row": F.lit(1)})
    shard = F.least(F.floor((F.col("__bytes") + F.col("size") / 2) * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int")
    lined = staged(lined.select("doc_id", "size", "text_crc32", shard.alias("shard"), "__row"), "lined")
    starts = lined.groupBy("shard").agg(F.min("__row").alias("__start"))
    return lined.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("__row") - F.col("__start")).cast("long").alias("slot"))

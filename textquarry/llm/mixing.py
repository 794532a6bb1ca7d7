"""Mixing sources to target weights (native).

Each source's documents form one stream of words, cut into blocks of fixed
length. Targets follow the weights, bounded by a number of passes; they say how
many blocks (slots of the output) each source needs. Every output shard draws
its source counts from a multinomial with these shares: each of its slots draws
a source by a keyed hash. A source's slots, in the order of the draw, go through
its own pseudorandom index permutation. Where the draw gave a source more slots
than it needs, those that come last in the permutation go to sources that drew
too few, so totals meet the targets. An index names a pass over the source and a
place in it; each pass has a permutation of block indices of its own, keyed by
the output slot at which the draw opens the pass. Blocks are joined by (source,
index).

Defined cases: null or blank texts have no words and are never taken; a null
source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives an empty mix. Columns other than doc_id, text
and source are ignored. A document that is not taken has no first slot (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import buckets_for, count_words, drawn_unit, permuted, running, staged

BLOCK = 256
SLOTS_PER_SHARD = 4096
WEIGHTS = (5, 2, 1)
PASSES = 3
CHUNK = 4096
#: Parts of the unit interval in which a draw looks up its source; with many sources, four for each.
GUIDE = 4096
#: Tables of a few rows for each source go to all tasks up to so many sources (some 20 MB); beyond, joins are shuffled.
MOST_SENT = 100_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sid, source, source_size, target: the total shared by weight, none above `passes` times its size.

    The bounded shares are min(cap, x * weight) for the one x that spends the
    total. In the order of cap / weight the bounded sources come first, so x is
    found from running sums over the sources (one row each).
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    ranked = by_source.select((F.row_number().over(named) - 1).cast("long").alias("sid"), "source", "source_size", w.alias("w"), (F.col("source_size") * passes).cast("double").alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, in this order, whose level fits under its own cap
    ranked = ranked.withColumn("x", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(whole)["level"])
    return ranked.select("sid", "source", "source_size", F.coalesce(F.least("cap", F.col("x") * F.col("w")), F.lit(0.0)).alias("target"))


def _sent(rows: DataFrame, n_sources: int) -> DataFrame:
    """rows, of which each source has a few, as the side of a join. Spark cannot tell sizes behind an explode."""
    return F.broadcast(rows) if n_sources <= MOST_SENT else rows.hint("shuffle_merge")


def slot_plan(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source with words: full and all blocks, complete passes, words left for the last pass, and the slots it needs."""
    size, take = F.col("source_size"), F.col("take_all")
    plan = targets.filter(size > 0).withColumn("take_all", F.least(F.floor(F.col("target") + 0.5), size * PASSES).cast("long"))
    plan = plan.withColumns({"full": F.floor(size / block).cast("long"), "n_blocks": F.ceil(size / block).cast("long"), "passes": F.floor(take / size).cast("long")})
    plan = plan.withColumn("rest", take - F.col("passes") * size)
    plan = plan.withColumn("need", (F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / block)).cast("long"))
    return plan.filter("need > 0").select("sid", "source_size", "full", "n_blocks", "passes", "rest", "need")


def draws(plan: DataFrame, per_shard: int = SLOTS_PER_SHARD, seed: str = "mix") -> DataFrame:
    """shard, slot, sid: every slot draws its source with the chance of its share, so a shard's counts are multinomial."""
    spark = plan.sparkSession
    n_slots, n_sources = plan.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    shards = -(-n_slots // per_shard)
    guide = max(GUIDE, 1 << (4 * n_sources - 1).bit_length() if n_sources else 1)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("need").over(before), F.lit(0)) / F.lit(max(1, n_slots))
    ranges = plan.select("sid", low.alias("low")).withColumn("high", F.lead("low", 1, 1.0).over(Window.orderBy("sid")))
    # a draw meets only the sources that share its part of the unit interval: two on average, however many there are
    parts = F.sequence(F.floor(F.col("low") * guide), F.greatest(F.floor(F.col("low") * guide), F.ceil(F.col("high") * guide) - 1))
    looked_up = ranges.withColumn("part", F.explode(parts))
    each = spark.range(0, shards, numPartitions=shards // 64 + 1).withColumnRenamed("id", "shard")
    each = each.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(per_shard), F.lit(n_slots) - F.col("shard") * per_shard) - 1)))
    each = each.withColumn("u", drawn_unit(F.lit(seed), F.lit("draw"), "shard", "slot"))
    each = each.withColumn("part", F.floor(F.col("u") * guide))
    return each.join(_sent(looked_up, n_sources), "part").filter("low <= u and u < high").select("shard", "slot", "sid")


def shard_counts(slot_rows: DataFrame) -> DataFrame:
    """Slots of each source in each output shard."""
    return slot_rows.groupBy("shard", "sid").agg(F.count("*").alias("n_slots"))


def indexed(drawn: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """shard, slot, sid, index: every index from 0 to need - 1 of each source at one slot."""
    counts = staged(shard_counts(drawn), "draw-counts")
    shards = (counts.agg(F.max("shard")).first()[0] or 0) + 1
    run = buckets_for(shards)
    starts = running(counts.withColumn("__run", F.floor(F.col("shard") / run)), ["sid"], ["__run"], [F.col("shard")], {"start": F.col("n_slots")})
    # one row per source
    got = plan.select("sid", "need").join(counts.groupBy("sid").agg(F.sum("n_slots").alias("got")), "sid", "left").select("sid", "need", F.coalesce("got", F.lit(0)).alias("got"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("got") - F.col("need"), F.lit(0)), F.greatest(F.col("need") - F.col("got"), F.lit(0))
    got = staged(got.select("sid", "need", "got", F.coalesce(F.sum(over).over(before), F.lit(0)).alias("over_before"), F.coalesce(F.sum(under).over(before), F.lit(0)).alias("under_before")), "draw-totals")
    n_sources = got.count()
    place = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    numbered = drawn.withColumn("place", place).join(starts.select("shard", "sid", "start").hint("shuffle_merge"), ["shard", "sid"]).join(_sent(got, n_sources), "sid")
    numbered = numbered.withColumn("index", permuted(F.col("start") + F.col("place"), F.col("got"), [F.lit(seed), F.lit("index"), F.col("sid")]))
    numbered = staged(numbered.select("shard", "slot", "sid", "index", "need", (F.col("over_before") + F.col("index") - F.col("need")).alias("rank")), "numbered")
    kept = numbered.filter("index < need").select("shard", "slot", "sid", "index")
    spare = numbered.filter("index >= need").select("shard", "slot", "rank")
    # what a source still needs, as ranks among the spare slots; two explodes, so that many tasks make them
    short = got.filter("got < need").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - F.col("got") - 1) / CHUNK))))
    short = short.withColumn("i", F.explode(F.sequence(F.col("part") * CHUNK, F.least((F.col("part") + 1) * CHUNK, F.col("need") - F.col("got")) - 1)))
    short = short.select("sid", (F.col("got") + F.col("i")).alias("index"), (F.col("under_before") + F.col("i")).alias("rank"))
    given = spare.join(short.hint("shuffle_merge"), "rank")
    return kept.unionByName(given.select("shard", "slot", "sid", "index"))


def slots(targets: DataFrame, block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD, seed: str = "mix") -> DataFrame:
    """One row per output slot: shard, slot, sid, block, pass_no, length of the block, take (words it takes from the block's head)."""
    plan = staged(slot_plan(targets, block), "plan")
    rows = indexed(staged(draws(plan, per_shard, seed), "draws"), plan, seed)
    n_sources = plan.count()
    rows = rows.join(_sent(plan, n_sources), "sid").withColumns({"pass_no": F.floor(F.col("index") / F.col("n_blocks")).cast("long"), "j": F.pmod("index", F.col("n_blocks"))})
    rows = staged(rows, "slots")
    # one row for each pass of each source
    opened = rows.filter("j = 0").select("sid", "pass_no", (F.col("shard") * per_shard + F.col("slot")).alias("opened"))
    each = rows.join(_sent(opened, n_sources), ["sid", "pass_no"])
    each = each.withColumn("block", F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), [F.lit(seed), F.col("sid"), F.col("pass_no"), F.col("opened")])).otherwise(F.col("full")))
    length = F.when(F.col("block") < F.col("full"), F.lit(block)).otherwise(F.col("source_size") - F.col("full") * block)
    taken = F.when(F.col("pass_no") == F.col("passes"), F.least(length, F.col("rest") - F.col("j") * block)).otherwise(length)
    return each.select("shard", "slot", "sid", "block", "pass_no", length.cast("long").alias("length"), taken.cast("long").alias("take"))


def packed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with sid, source_size, target and start, the place of its first word in its source's stream."""
    t = targets.select("sid", F.col("source").alias("__source"), "source_size", "target")
    known = sized.join(_sent(t, targets.count()), sized["source"].eqNullSafe(t["__source"]), "left").drop("__source")
    known = known.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", F.lit("pack")), F.lit(buckets_for(sized.count()))))
    return running(known, ["sid"], ["__bucket"], [F.col("doc_id"), F.col("size")], {"start": F.col("size")}).drop("__bucket")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: str = "mix", per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """doc_id, source, size, source_size, target, start, taken, first_shard, first_slot.

    `taken` counts the words of a document in all slots that hold some of them;
    the first of these slots, by shard and slot, is given too.
    """
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size")), "sizes")
    targets = staged(source_targets(sized, weights), "targets")
    place, whole = F.col("shard") * per_shard + F.col("slot"), F.col("take") == F.col("length")
    drawn = slots(targets, block, per_shard, seed).groupBy("sid", "block").agg(
        F.count(F.when(whole, 1)).alias("times"), F.max(F.when(whole, 0).otherwise(F.col("take"))).alias("head"),
        F.min(F.when(whole, place)).alias("whole_at"), F.min(F.when(whole, None).otherwise(place)).alias("head_at"),
    )
    placed = staged(packed(sized, targets), "packed")
    filled = placed.filter("size > 0")
    parts = filled.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.select("sid", "start", low.alias("low"), high.alias("high"), "block")
    words = F.col("times") * (F.col("high") - F.col("low")) + F.greatest(F.lit(0), F.least("high", "head") - F.col("low"))
    first = F.least("whole_at", F.when(F.col("head") > F.col("low"), F.col("head_at")))
    taken = parts.join(drawn.hint("shuffle_merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(words).alias("__taken"), F.min(first).alias("__first"))
    columns = ["doc_id", "source", "size", "source_size", "target", "start"]
    some = filled.join(taken.hint("shuffle_merge"), ["sid", "start"], "left").select(*columns, F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"), "__first")
    none = placed.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("__first"))
    both = some.unionByName(none)
    return both.select(*columns, "taken", F.floor(F.col("__first") / per_shard).cast("long").alias("first_shard"), F.pmod("__first", F.lit(per_shard)).cast("long").alias("first_slot"))

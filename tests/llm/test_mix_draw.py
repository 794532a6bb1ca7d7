"""The mix against a word-by-word count of its slots, its draw, and the registered query."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from tests.llm.test_native import _targets
from textquarry.llm import mixing, registry
from textquarry.llm.common import count_words

SMALL = {"block": 16, "per_shard": 32}


def _sized(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words(F.col("text")).alias("size"))


def test_taken_and_first_slot_by_counting_words(odd_docs):
    rows = mixing.mix(odd_docs, **SMALL).collect()
    targets = mixing.source_targets(_sized(odd_docs))
    slots = mixing.slots(targets, 16, 32).collect()
    names = {r["sid"]: r["source"] for r in targets.collect()}
    used = defaultdict(list)
    for r in slots:
        for word in range(r["block"] * 16, r["block"] * 16 + r["take"]):
            used[names[r["sid"]], word].append((r["shard"], r["slot"]))
    for r in rows:
        places = [p for w in range(r["start"], r["start"] + r["size"]) for p in used[r["source"], w]]
        assert r["taken"] == len(places)
        assert (r["first_shard"], r["first_slot"]) == (min(places) if places else (None, None))
    # every complete pass takes every block once
    passes = Counter((r["sid"], r["pass_no"], r["block"]) for r in slots)
    assert set(passes.values()) == {1}


def _shares(rows, shards):
    by_shard = Counter((r["shard"], r["sid"]) for r in rows)
    return [[by_shard[s, k] for s in range(shards)] for k in sorted({r["sid"] for r in rows})]


def test_counts_of_the_draw_vary_like_a_multinomial(spark):
    plan = spark.createDataFrame([(0, 100, 10, 10, 1, 0, 32_000), (1, 100, 10, 10, 1, 0, 24_000), (2, 100, 10, 10, 1, 0, 8_000)], "sid long, source_size long, full long, n_blocks long, passes long, rest long, need long")
    drawn = mixing.draws(plan, per_shard=64).collect()
    assert len(drawn) == 64_000 == len({(r["shard"], r["slot"]) for r in drawn})
    for counts, share in zip(_shares(drawn, 1000), (0.5, 0.375, 0.125), strict=True):
        mean = sum(counts) / 1000
        var = sum((c - mean) ** 2 for c in counts) / 999
        assert abs(mean - 64 * share) < 0.6 and 0.85 < var / (64 * share * (1 - share)) < 1.15
    # the totals are mended to what each source needs, every index once
    got = mixing.indexed(mixing.draws(plan, per_shard=64), plan).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 64_000
    for sid, need in ((0, 32_000), (1, 24_000), (2, 8_000)):
        assert sorted(r["index"] for r in got if r["sid"] == sid) == list(range(need))
    moved = sum(a["sid"] != b["sid"] for a, b in zip(sorted(drawn), sorted(got, key=lambda r: (r["shard"], r["slot"])), strict=True))
    assert 0 < moved < 2000


def test_without_the_draw_the_mix_is_another(odd_docs, monkeypatch):
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["start"])
    before = {key(r): r for r in mixing.mix(odd_docs, **SMALL).collect()}

    def in_turn(plan, per_shard, seed):
        row = plan.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need")))).select("sid", "i").collect()
        return plan.sparkSession.createDataFrame([(n // per_shard, n % per_shard, r["sid"]) for n, r in enumerate(sorted(row))], "shard long, slot long, sid long")

    monkeypatch.setattr(mixing, "draws", in_turn)
    after = {key(r): r for r in mixing.mix(odd_docs, **SMALL).collect()}
    assert before.keys() == after.keys()
    assert sum(before[k]["taken"] != after[k]["taken"] for k in before) > 5
    assert sum(before[k]["first_shard"] != after[k]["first_shard"] for k in before) > 30
    assert sum(r["taken"] for r in before.values()) == sum(r["taken"] for r in after.values())


def test_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit("one two three").alias("text"))
    rows = mixing.mix(docs, block=2, per_shard=64).collect()
    assert len(rows) == 3000 and all(abs(r["taken"] - r["target"]) <= 0.51 for r in rows)


def test_query(spark, tmp_path):
    rows = registry.queries()["op3_mix_sources"](spark, "/root/testdata/sf0.001")
    kinds = dict(rows.dtypes)
    assert rows.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and [kinds[c] for c in rows.columns[:5]] == ["bigint", "bigint", "bigint", "double", "bigint"]
    seen = rows.collect()
    given = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in seen) == sorted(given)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in given.items()}
    whole = Counter()
    for i, r in given.items():
        whole[r["source"]] += size[i]
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    want = _targets(dict(whole), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = Counter()
    for r in seen:
        source = given[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[source] and abs(r["target"] - want[source]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(tuple, seen)) == sorted(map(tuple, registry.queries()["op3_mix_sources"](spark, "/root/testdata/sf0.001").collect()))


def test_one_very_long_text(spark):
    import random

    docs = spark.createDataFrame([(1, sentence(random.Random(1), 200_000), "a"), (2, "few words", "b")], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert rows[2]["taken"] == 6 and abs(rows[1]["taken"] - rows[1]["target"]) <= 1

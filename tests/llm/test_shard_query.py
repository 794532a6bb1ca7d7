"""The registered query op4 by brute force, ties and equal sizes, and how many buckets its sums need."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from textquarry.llm import common, registry, sharding


def _check(rows, given):
    """rows against the contract's law `bytes`; given: [(doc_id, text)]."""
    raw = [(i, (t or "").encode()) for i, t in given]
    want = Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in raw)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 24
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = registry.queries()["op4_balanced_shards"](spark, folder)
    assert rows.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and [t for _, t in rows.dtypes[:7]] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    seen = rows.collect()
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    load = _check(seen, given)
    total, largest = sum(load.values()), max(r["size"] for r in seen)
    assert all(abs(load[s] - total / 24) <= largest for s in range(24))
    assert {(r["law"], r["grown_shard"]) for r in seen} == {("bytes", None)}
    text = dict(given)
    placed = defaultdict(set)
    for r in seen:
        placed[text[r["doc_id"]]].add(r["shard"])
    copies = Counter(text.values())
    groups = [t for t, n in copies.items() if n > 1]
    assert groups and sum(len(placed[t]) == 1 for t in groups) >= 0.9 * len(groups)
    assert sorted(map(tuple, seen), key=repr) == sorted(map(tuple, registry.queries()["op4_balanced_shards"](spark, folder).collect()), key=repr)


@pytest.mark.parametrize("texts", [["same size"] * 500, [f"doc {i:04d}" for i in range(500)], [None] * 60 + [""] * 60, ["x"], ["a", "b" * 100_000, "c"]])
def test_ties_and_equal_sizes(spark, texts):
    given = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id")]
    rows = sharding.assign(frame(spark, [(i, t, "en", "a") for i, t in given])).collect()
    load = _check(rows, given)
    if len(set(texts)) in (1, 500) and len(texts) == 500:
        assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in rows)


def test_buckets_grow_with_the_root(spark, monkeypatch):
    """Each sum over all buckets sees a number of rows that grows with the root of the documents."""
    heads = {}
    real = common.running

    def counted(df, within, bucket, order, sums):
        heads[current] = max(heads.get(current, 0), df.select(*within, *bucket).distinct().count())
        return real(df, within, bucket, order, sums)

    monkeypatch.setattr(sharding, "running", counted)
    for current in (4_000, 64_000):
        ids = spark.range(current).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % (current // 2)).cast("string"))).alias("text"))
        sharding.assign(ids).count()
    assert heads[64_000] < 6 * heads[4_000]

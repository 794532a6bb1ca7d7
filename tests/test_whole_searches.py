"""Whole texts and the whole query set."""

import numpy as np
import pytest

from tests.oracle import DATA
from textquarry.operators import vector
from textquarry.plans import catalog_queries as q

SF = f"{DATA}/sf0.001"


def test_seed_of_whole_texts(spark):
    got = {r["item_id"]: r["seed"] for r in q.v06_hash_seed(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        seed = 2166136261
        for byte in r["text"].encode():
            seed = ((seed ^ byte) * 16777619) & 0xFFFFFFFF
        assert got[r["item_id"]] == seed


@pytest.mark.parametrize("block", [256, 4])
def test_every_twentieth_vector_is_searched(spark, block, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", block)
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in q.v01_knn_l2(spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_key"]
    assert sorted(got) == [i for i in sorted(rows) if i % 20 == 0]
    for i, ranks in got.items():
        best = {}
        for j, v in rows.items():
            best[j // 2] = min(best.get(j // 2, 9.0), float(np.sqrt(((v - rows[i]) ** 2).sum())))
        assert [ranks[k] for k in range(1, 11)] == sorted(best, key=lambda d: (best[d], d))[:10]

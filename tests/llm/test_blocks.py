"""Decontamination gives one row per input row, however many blocks the benchmark takes."""

import random

from tests.llm.conftest import frame, sentence
from textquarry.llm import decontam


def test_equal_rows_for_one_and_two_blocks(spark, monkeypatch):
    draw = random.Random(4)
    items = [(i, sentence(draw, 30)) for i in range(20)]
    texts = [sentence(draw, 50), items[3][1] + " tail", "", None]
    rows = [(i, t) for t in texts for i in (1, 1, None, None, 2)]
    docs = frame(spark, [(i, t, "en", "x") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")

    def run():
        got = decontam.find(docs, bench, ["doc_id", "text"]).collect()
        return sorted(((r["doc_id"], r["text"], r["__n_words"], tuple(r["__starts"]), tuple(r["__ends"]), tuple(sorted(r["__items"]))) for r in got), key=repr)

    one = run()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1 + sum(len(t) for _, t in items) // 2)
    two = run()
    assert len(one) == len(rows) and two == one
    assert sum(bool(r[3]) for r in one) == 5

"""Which rows stay when ids repeat or are null."""

import random

import pytest

from tests.llm.conftest import frame, sentence
from tests.llm.test_free import _components
from textquarry.llm import neardup


def test_repeated_and_null_ids(spark):
    draw = random.Random(8)
    a, b, c, d, e = (sentence(draw, 60) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, d), (None, e), (None, d), (8, ""), (8, ""), (9, None), (10, e)]
    kept = neardup.keep_one(frame(spark, [(i, t, "en", "x") for i, t in rows]))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, a), (5, b), (7, c), (None, d), (None, e), (None, d), (8, ""), (9, None), (10, e)], key=repr)


def test_two_texts_of_one_id_both_stay(spark):
    draw = random.Random(9)
    a, b, c = (sentence(draw, 60) for _ in range(3))
    kept = neardup.keep_one(frame(spark, [(5, a, "en", "x"), (5, b, "en", "x"), (6, a + " tail", "en", "x"), (4, c, "en", "x")]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, a), (5, b), (4, c)])
    assert "__row" not in kept.columns


@pytest.mark.parametrize("levels", [1, 2])
def test_nodes_that_stay_mixed_lose_no_link(spark, monkeypatch, levels):
    """The prefix join behind the last level finds what a comparison of all pairs finds."""
    for name, value in (("SMALL", 4), ("PIVOTS", 2), ("FULL", 0), ("LEVELS", levels)):
        monkeypatch.setattr(neardup, name, value)
    draw = random.Random(7)
    base = sentence(draw, 50).split()
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(draw.choice([0, 2, 3, 5, 9])):
            words[draw.randrange(50)] = f"edit{draw.randrange(30)}"
        rows.append((i, " ".join(words), "en", "a"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(frame(spark, rows), 3, 85, 100).collect()}
    assert got == _components([(i, t) for i, t, _, _ in rows], 3, 85, 100)


def test_prefix_pairs_hold_every_link(spark):
    draw = random.Random(8)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.sample(pool, 30)[: draw.randint(18, 30)]) for _ in range(60)] + [" ".join(pool[:30])] * 1
    sets = [frozenset(t.split()) for t in texts]
    nodes = spark.createDataFrame([(1, i, i) for i in range(len(texts))], "node long, rep long, label long")
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {tuple(r) for r in neardup._prefix_pairs(nodes, docs, 1, 60, 100).collect()}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])}
    assert linked and linked <= got

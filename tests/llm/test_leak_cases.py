"""Decontamination by brute force: items without ids, equal items, repeated rows, any number of blocks."""

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from textquarry.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG = " ".join(f"w{i}" for i in range(14))
ITEMS = [(1, LONG), (None, LONG), (2, LONG.upper()), (None, "two words"), (3, "Two, words!"), (4, None), (5, " ,. "), (6, "solo"), (None, "never here at all"), (7, LONG + " é x y"), (8, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 other end")]
TEXTS = [f"a b {LONG} c", "two words and solo", "nothing", None, "", LONG, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13", "TWO  words", f"{LONG} {LONG} é x", "solo solo"]


def _words(t):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def _by_hand(text):
    ws, hit, items = _words(text), set(), set()
    for item, t in ITEMS:
        iw = _words(t)
        k = min(10, len(iw))
        for a in range(len(iw) - k + 1 if k else 0):
            for p in range(len(ws) - k + 1):
                if ws[p : p + k] == iw[a : a + k]:
                    hit |= set(range(p, p + k))
                    items.add(item)
    return len(ws), len(hit), len(items), ",".join(sorted(str(i) for i in items if i is not None))


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_against_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "en", "a")] * 2 + [(3, TEXTS[1], "en", "a")]
    docs = frame(spark, rows).selectExpr("*", "1 as __row", "2 as item_id", "3 as s", "4 as e")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.find(docs, items, ["doc_id", "s"])
    listed = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    got = sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in found.select("doc_id", "__n_words", decontam.hit_words(), F.size("__items"), listed).collect())
    assert got == sorted(((i is None, i or 0), *_by_hand(t)) for i, t, _, _ in rows)

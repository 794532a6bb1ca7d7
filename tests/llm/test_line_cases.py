"""Line dedup by brute force: null ids, repeated rows, hot lines, clashing columns and very long texts."""

import random
import re
from collections import defaultdict

import pytest

from tests.llm.conftest import frame
from textquarry.llm import common, lines


def _by_hand(rows, least):
    own = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x)
    sites = defaultdict(set)
    for _, text, _, site in rows:
        for x in (text or "").split("\n"):
            sites[own(x)].add(site)
    out = []
    for i, text, _, _ in rows:
        parts = [] if text is None else text.split("\n")
        kept = [x for x in parts if not own(x) or len(sites[own(x)]) < least]
        out.append((i, None if text is None else "\n".join(kept), sum(1 for x in parts if own(x)), len(parts) - len(kept)))
    return sorted(out, key=repr)


def _rows():
    draw = random.Random(3)
    pool = [f"line {k}" for k in range(40)]
    rows = [(i, "\n".join([draw.choice(pool) for _ in range(draw.randint(0, 6))] + ["  the licence \t"]), "en", f"s{draw.randrange(9)}") for i in range(300)]
    rows += [(None, "the licence\nnull id", "en", "s1"), (None, "another\nthe licence\n\nthe licence", "en", None), (None, None, None, None), (7, rows[7][1], "en", "s3"), (7, rows[7][1], "en", "s4"), (900, "", "en", "s0"), (901, "\n \n", "en", "s0")]
    return rows


@pytest.mark.parametrize("share", [8192, 4])
def test_against_a_plain_loop(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HEAVY_SHARE", share)
    rows = _rows()
    docs = frame(spark, rows).selectExpr("*", "1 as line_hash", "2 as bad", "3 as text_hash", "4 as site", "5 as __maybe", "6 as pos")
    got = sorted((tuple(r) for r in lines.remove_boilerplate(docs, min_sites=5).collect()), key=repr)
    assert got == _by_hand(rows, 5)


def test_one_long_text_of_many_shared_lines(spark):
    n = 60_000
    rows = [(0, "\n".join(f"x{k}" if k % 2 else "shared" for k in range(n)), "en", "s0")] + [(i, "shared", "en", f"s{i}") for i in range(1, 6)]
    got = {r["doc_id"]: r for r in lines.remove_boilerplate(frame(spark, rows), min_sites=5).collect()}
    assert got[0]["n_removed"] == n // 2 and got[0]["text"] == "\n".join(f"x{k}" for k in range(1, n, 2)) and got[3]["text"] == ""

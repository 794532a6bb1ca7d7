"""Whole tables and every row: queries held against brute force on small fixtures."""

import math
import random
import re

from textquarry.operators import evaluation
from textquarry.plans import catalog_queries as q


def _tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _benchmark():
    """25 items in up to 14 documents each, changed in case and marks; one item in none; decoys with all its words."""
    draw = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "no", "se") for b in ("rt", "sk", "mer", "tion", "dle")]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(4, 12))) + ".") for i in range(25)] + [(25, "nowhere held zzz"), (26, None)]
    docs = []
    for i, text in items[:25]:
        for k in range(14 if i == 11 else 1 + i % 3):
            around = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 40))) for _ in range(2)]
            docs.append(f"{around[0]} {text.upper().replace(' ', ', ') if k % 2 else text} {around[1]}")
        turned = text.rstrip(".").split()[::-1]
        docs += [" ".join(turned), " ".join(turned * 3)]
    return items, [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(docs)]


def _terms(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def _averages(items, docs):
    """BM25 over all words, fillers aside, and the averages, by plain loops."""
    terms = {d: _terms(t) for d, t, *_ in docs}
    place = {d: (s, f"en/{d}.md") for d, _, _, s, _ in docs}
    mean = sum(map(len, terms.values())) / len(terms)
    rows = []
    for _, text in items:
        asked = _terms(text)
        met = {w: [d for d in terms if w in terms[d]] for w in set(asked)}
        scored = []
        for d, own in terms.items():
            if asked and all(w in own for w in asked):
                score = 0.0
                for w in asked:
                    idf = math.log((len(terms) - len(met[w]) + 0.5) / (len(met[w]) + 0.5))
                    f = own.count(w)
                    score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / mean))
                scored.append((-round(score, 9), place[d], d))
        found = [x for _, (_, path), d in sorted(scored)[:10] for x in (path, f"id{d}")]
        needle = f" {' '.join(asked)} "
        good = {place[d][1] for d, own in terms.items() if asked and needle in f" {' '.join(own)} "}
        hit = [x in good for x in found]
        rows.append([sum(hit[:k]) / k for k in (1, 5, 10)] + [sum(hit[:k]) / len(good) if good else 0.0 for k in (5, 10)] + [1 / (1 + hit.index(True)) if True in hit else 0.0])
    return [sum(r[k] for r in rows) / len(rows) for k in range(6)]


def test_benchmark_run_takes_every_item(spark, tmp_path):
    items, docs = _benchmark()
    folder = _tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), benchmark=(items, "item_id long, text string"))
    got = q.x16_benchmark_run(spark, folder).first()
    wanted = _averages(items, docs)
    assert 0.1 < wanted[5] < 0.9
    assert all(abs(got[c] - w) <= 0.0006 for c, w in zip(("p_at_1", "p_at_5", "p_at_10", "r_at_5", "r_at_10", "mrr"), wanted, strict=True)), (got, wanted)


def test_holders_are_found_without_a_ranking(spark):
    items, docs = _benchmark()
    rows = spark.createDataFrame([(f"{d}", _terms(t)) for d, t, *_ in docs], "path string, terms array<string>")
    got = {r["query_id"]: set(r["relevant"]) for r in evaluation.holders(rows, [(i, _terms(t)) for i, t in items]).collect()}
    for i, text in items:
        needle = f" {' '.join(_terms(text))} "
        assert got[i] == {f"{d}" for d, t, *_ in docs if _terms(text) and needle in f" {' '.join(_terms(t))} "}
    assert len(got[11]) == 14

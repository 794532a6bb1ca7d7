"""The registered query op1: base columns against Python's regular expressions, and what the Markov models find on real text."""

import hashlib
import random

from tests.llm.conftest import SCHEMA
from tests.llm.test_native import _base_spans
from textquarry.llm import registry, secrets


def _spans(joined):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in joined.split(",") if s)]


def test_query_base_columns(spark):
    rows = registry.queries()["op1_secret_scan"](spark, "/root/testdata/sf0.01")
    assert rows.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and [t for _, t in rows.dtypes[:6]] == ["bigint"] * 4 + ["string"] * 2
    given = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    seen = rows.collect()
    assert sorted(given) == sorted(r["doc_id"] for r in seen)
    found = labelled = right = 0
    for r in seen:
        text = given[r["doc_id"]]
        base = _base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        spans = _spans(r["spans"])
        assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]))) and set(base) <= set(r["spans"].split(","))
        own = [s for s in spans if s[0] == "markov"]
        # by base rules: every long value, and whether what the models find lies in one
        values = [s for s in _spans(",".join(base)) if s[0] != "assign" or len(text[s[1] : s[2]].split("=")[-1].strip(" \"'")) >= 20]
        labelled += len(values)
        right += sum(any(m[1] < v[2] and v[1] < m[2] for m in own) for v in values)
        found += sum(any(m[1] < v[2] and v[1] < m[2] for v in values) for m in own) - len(own)
    assert labelled > 10 and right == labelled and found == 0, (labelled, right, found)


def test_precision_and_coverage_on_held_out_strings(spark):
    """Random strings of four alphabets against identifiers, paths and long words, none of them in the samples."""
    draw = random.Random(8)
    hexes, base64 = "0123456789abcdef", secrets.ALPHABET[:64]
    strings = [("".join(draw.choice(a) for _ in range(draw.randint(24, 48))), True) for a in (hexes, hexes.upper(), base64, secrets.ALPHABET[:62]) for _ in range(150)]
    words = ["acme", "river", "budget", "quarter", "summary", "parser", "socket", "vector", "matrix", "garden", "window", "letter", "report", "planet", "signal", "mentation", "ungen", "weather", "station"]
    for join in ("_", "-", "/", ""):
        strings += [(join.join(draw.choice(words) for _ in range(4)), False) for _ in range(150)]
    model = secrets.train(secrets.labelled_samples(spark))
    docs = spark.createDataFrame([(i, f"see {s} here", "en", "a", 0) for i, (s, _) in enumerate(strings)], SCHEMA)
    hit = {r["doc_id"]: any(s["kind_no"] == 3 for s in r["spans"]) for r in secrets.scan(docs, model).collect()}
    caught = sum(hit[i] for i, (_, label) in enumerate(strings) if label)
    wrong = sum(hit[i] for i, (_, label) in enumerate(strings) if not label)
    assert caught >= 0.97 * 600 and wrong <= 0.01 * 600, (caught, wrong)


def test_one_very_long_text_of_tokens(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    docs = spark.createDataFrame([(1, f"{token} " * 40_000, "en", "a", 0)], SCHEMA)
    spans = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark))).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans if s["kind_no"] == 2] == [(41 * i, 41 * i + 40) for i in range(40_000)]
    assert sum(s["kind_no"] == 3 for s in spans) == 40_000

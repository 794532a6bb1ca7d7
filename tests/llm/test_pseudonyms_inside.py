"""Personal data inside candidates that are not valid, and short or long local parts."""

import re

from pyspark.sql import functions as F

from tests.llm.conftest import frame
from textquarry.llm import pii

CARD = "4111111111111111"
INSIDE = [
    (f"{CARD} 12/25", CARD, "card"), (f"{CARD} 123", CARD, "card"), (f"a 4111 1111 1111 1111 12 b {CARD}.", "4111 1111 1111 1111", "card"), ("1234 4111 1111 1111 1112 34 4111-1111-1111-1111", "4111-1111-1111-1111", "card"),
    ("2020 123-45-6789", "123-45-6789", "ssn"), ("123-45-6789 12345", "123-45-6789", "ssn"), ("0000 0000 0001 123-45-6789 x", "123-45-6789", "ssn"), ("12345 1984-02-29", "1984-02-29", "date"), ("2020 743-555-3824", "743-555-3824", "phone"),
    ("BE68 5390 0754 7034 NOTE", "BE68 5390 0754 7034", "iban"), ("AB12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
]


def _run(spark, texts):
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    return [r.asDict() for r in pii.pseudonymise(docs, "key", ["doc_id"]).orderBy("doc_id").collect()]


def test_values_inside_failed_candidates(spark):
    rows = _run(spark, [t for t, _, _ in INSIDE])
    for (text, value, kind), r in zip(INSIDE, rows, strict=True):
        assert value not in r["text"], (text, r)
        assert r[f"n_{kind}"] >= 1, (text, r)
        assert re.sub("[0-9]", "0", r["text"]) == re.sub("[0-9]", "0", text)
    assert rows[0]["text"].endswith(" 12/25") and rows[4]["text"].startswith("2020 ") and rows[5]["text"].endswith(" 12345")


def test_what_is_not_valid_stays(spark):
    texts = ["4111 1111 1111 1112 and 000-12-3456", "1985-02-29", "999.1.1.1 v1.2.3.4.5", "x", "", "1 2 3 4 5 6 7 8 9 0 1 2 3", "GB82 WEST 1234"]
    assert [r["text"] for r in _run(spark, texts)] == texts


def test_short_and_long_local_parts(spark):
    long = "abcdefghijklmnopqrstuvwxyzabcdefghijk"
    texts = ["j@x.com", "j7@x.com", "J.7@x.com", "7@x.com", f"{long}@x.com", f"{long[:25]}@x.com", f"a{'1234567890' * 4}@x.com", "hein.19@x.com"]
    for t, r in zip(texts, _run(spark, texts), strict=True):
        before, after = t.lower().split("@")[0], r["text"].split("@")[0]
        assert r["n_email"] == 1 and r["text"].endswith("@x.com")
        assert re.sub("[a-z]", "a", re.sub("[0-9]", "0", after)) == re.sub("[a-z]", "a", re.sub("[0-9]", "0", before))
        for kind in ("[^a-z]", "[^0-9]"):
            a, b = re.sub(kind, "", before), re.sub(kind, "", after)
            size = 24 if kind == "[^a-z]" else 36
            assert all(a[k : k + size] != b[k : k + size] for k in range(0, len(a), size)), (t, r["text"])


def test_the_shift_of_one_character_is_one_to_one(spark):
    docs = frame(spark, [(i, f"{c}@x.com", "en", "a") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")])
    out = [r[0] for r in pii.pseudonymise(docs, "key", ["doc_id"]).select(F.substring("text", 1, 1)).collect()]
    assert sorted(out) == sorted("abcdefghijklmnopqrstuvwxyz0123456789")

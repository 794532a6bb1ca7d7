"""The registered queries op5, op9 and op10: names, types, and values by brute force or held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np

from textquarry.llm import registry

FOLDER = "/root/testdata/sf0.001"


def _run(spark, name, folder=FOLDER):
    rows = registry.queries()[name](spark, folder)
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    seen = rows.collect()
    assert sorted(r["doc_id"] for r in seen) == sorted(given)
    return dict(rows.dtypes), rows.columns, seen, given


def test_language_on_held_out_documents(spark):
    kinds, columns, seen, given = _run(spark, "op5_string_kernel", "/root/testdata/sf0.01")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and [kinds[c] for c in columns[:4]] == ["bigint", "boolean", "string", "double"]
    right = Counter()
    for r in seen:
        held = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        text, lang = given[r["doc_id"]]["text"], given[r["doc_id"]]["lang"]
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if not text or not any(map(str.isalpha, text)):
            assert r["lang_pred"] == "und"
        elif held and lang is not None:
            right[r["lang_pred"] == lang] += 1
    assert right[True] > 100 and right[True] >= 0.99 * sum(right.values()), right


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    kinds, columns, seen, given = _run(spark, "op9_token_files")
    assert columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and [kinds[c] for c in columns[:4]] == ["bigint"] * 4
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, at = {r["doc_id"]: r for r in seen}, 0
    for i in sorted(given):
        ids = tokenizer.encode(given[i]["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(rows[i])[:4] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_quality_base_columns(spark):
    kinds, columns, seen, given = _run(spark, "op10_decision_list")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert columns[:8] == names and [kinds[c] for c in names] == ["bigint"] * 6 + ["boolean"] * 2
    for r in seen:
        text = given[r["doc_id"]]["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert tuple(r)[1:6] == want and r["base_failed"] == failed and not (failed and r["kept"])
    assert any(r["kept"] for r in seen)

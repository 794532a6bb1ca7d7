import json

import pytest

from textquarry.__main__ import parser, run
from textquarry.functions.text import human_bytes, shortened
from textquarry.operators import rerank
from textquarry.operators.catalog import CatalogError
from textquarry.plans.engine import Engine


def test_verbs(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("# Alpha\nred apples\ngreen pears")
    (folder / "b.md").write_text("# Beta\ngreen apples")
    engine = Engine(spark, str(tmp_path / "i"))

    def say(*words: str) -> str:
        return run(engine, parser().parse_args(words))

    assert say("collection", "add", str(folder)).startswith("notes")
    assert say("context", "check") == "notes"
    assert say("context", "add", "notes/sub", "about fruit") == "notes\tsub\tabout fruit"
    assert say("index") == "indexed 2, updated 0, unchanged 0, removed 0"
    assert say("search", "pears", "--files").split(",")[2] == "notes/a.md"
    assert json.loads(say("search", "green", "apples", "--json"))[0]["collection"] == "notes"
    assert say("get", "a.md:2") == "red apples\ngreen pears"
    assert say("multi-get", "*.md").count("---") == 1
    with pytest.raises(CatalogError, match="did you mean"):
        say("get", "a.txt")
    assert say("embed") == "embedded 2"
    assert "b.md" in say("query", "apples", "--files")
    judged = tmp_path / "q.jsonl"
    judged.write_text('{"query": "pears", "relevant": ["a.md"]}\n')
    assert say("bench", str(judged)).endswith("1.0")
    engine.drop_embeddings("a.md")
    assert say("embed") == "embedded 1"
    engine.drop_embeddings()
    assert say("cleanup") == "orphaned_chunks 0, stale_embeddings 0"
    assert "BAD" not in say("doctor")


def test_failing_reranker_keeps_the_first_ranking(spark):
    class Broken:
        def score(self, query, texts):
            raise OSError("away")

    hits = spark.createDataFrame([(0, i + 1, "q", "t") for i in range(3)], "query_id long, rank int, query string, snippet string")
    got = rerank.blended(rerank.with_logits(hits, Broken(), strict=False)).orderBy("rank").collect()
    assert [r["first_rank"] for r in got] == [1, 2, 3] and {r["rerank_score"] for r in got} == {0.5}


def test_display():
    assert [human_bytes(n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.00 KB", "3.00 MB", "5.00 GB"]
    assert shortened("abcdef", 4) == "abc…"

"""Segments of the engine: what increments give, renames, commits, cleanup, prompts and judgements."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as X
from textquarry.operators import expansion, lexical, vector
from textquarry.operators.catalog import CatalogError
from textquarry.plans import engine as E
from textquarry.plans.engine import Engine, SearchOptions
from textquarry.sources.readers import read_qrels

WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
DOCS = "collection string, path string, absolute_path string, content string, updated_at timestamp"


def _docs(spark, rows):
    return spark.createDataFrame([(c, p, f"/{c}/{p}", t, None) for c, p, t in rows], DOCS)


def _texts(draw, names, collection="c"):
    return [(collection, n, " ".join(draw.choices(WORDS, k=draw.randint(3, 30)))) for n in names]


def _hits(engine, query):
    return [(r["rank"], r["path"], round(r["score"], 9)) for r in engine.search(query, SearchOptions(limit=50)).orderBy("rank").collect()]


def _segments(engine):
    return len(engine._state["segments"])


@pytest.mark.parametrize("most", [8, 2])
def test_increments_equal_a_fresh_index(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_SEGMENTS", most)
    draw = random.Random(4)
    engine = Engine(spark, str(tmp_path / "a"))
    state = {n: t for _, n, t in _texts(draw, [f"{i}.md" for i in range(12)])}
    engine.index_documents(_docs(spark, [("c", n, t) for n, t in state.items()]))
    for turn in range(2):
        fresh = {n: t for _, n, t in _texts(draw, [f"{turn}.md", f"{turn + 5}.md", f"new{turn}.md"])}
        state |= fresh
        counts = engine.upsert_documents(_docs(spark, [("c", n, t) for n, t in fresh.items()]))
        assert counts["indexed"] == 1 and counts["updated"] + counts["unchanged"] == 2 and counts["removed"] == 0
    state.pop("3.md")
    assert engine.index_documents(_docs(spark, [("c", n, t) for n, t in state.items()]))["removed"] == 1
    assert _segments(engine) <= most + 1 and (most == 2 or _segments(engine) == 4)
    whole = Engine(spark, str(tmp_path / "b"))
    whole.index_documents(_docs(spark, [("c", n, t) for n, t in state.items()]))
    assert {r["path"]: r["content"] for r in engine.table("documents").collect()} == state
    for query in ("birch -cedar", '"delta ember"'):
        assert _hits(engine, query) == _hits(whole, query) and _hits(engine, query)
    engine.merge()
    assert _segments(engine) == 1 and _hits(engine, "amber") == _hits(whole, "amber")
    assert engine.table("chunks").count() == whole.table("chunks").count()


def test_an_unchanged_snapshot_writes_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    rows = _docs(spark, [("c", "a.md", "amber"), ("c", "b.md", "birch")])
    engine.index_documents(rows)
    version = engine._state["version"]
    assert engine.index_documents(rows)["unchanged"] == 2 and engine.upsert_documents(rows.limit(1))["unchanged"] == 1
    assert engine._state["version"] == version


def test_a_new_collection_of_an_old_name(spark, tmp_path):
    embedder = vector.HashEmbedder(8)
    engine = Engine(spark, str(tmp_path))
    for name in ("a", "x"):
        (tmp_path / "files" / name).mkdir(parents=True)
        (tmp_path / "files" / name / "one.md").write_text(f"amber from {name}")
    engine.add_collection(str(tmp_path / "files" / "a"))
    engine.index()
    assert engine.embed(embedder) == 1
    engine.rename_collection("a", "b")
    assert engine.embed(embedder) == 0  # the vector went along
    assert [r["collection"] for r in engine.search_similar("amber from a", embedder).collect()] == ["b"]
    engine.add_collection(str(tmp_path / "files" / "x"), name="a")
    engine.upsert_documents(_docs(spark, [("a", "one.md", "amber from x")]))
    docs = engine.table("documents").collect()
    assert {(d["collection"], d["content"]) for d in docs} == {("a", "amber from x"), ("b", "amber from a")} and len({d["doc_key"] for d in docs}) == 2
    assert sorted((r["collection"], r["path"]) for r in engine.search("amber").collect()) == [("a", "one.md"), ("b", "one.md")]
    keys = {d["doc_key"] for d in docs}
    assert {c["doc_key"] for c in engine.table("chunks").collect()} == keys
    engine.remove_collection("b")
    assert [r["collection"] for r in engine.search("amber").collect()] == ["a"]


def test_a_version_is_written_once(spark, tmp_path):
    one = Engine(spark, str(tmp_path))
    one.index_documents(_docs(spark, [("c", "a.md", "amber")]))
    two = Engine(spark, str(tmp_path))
    one.set_metadata("k", "one")
    with pytest.raises(CatalogError, match="written by another"):
        two.set_metadata("k", "two")
    assert Engine(spark, str(tmp_path)).metadata("k") == "one"
    assert Engine(spark, str(tmp_path)).search("amber").count() == 1


def test_cleanup_leaves_what_others_may_commit(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    for text in ("amber", "birch", "cedar"):
        engine.index_documents(_docs(spark, [("c", "a.md", text)]))
    other = tmp_path / "default" / "segment-of-another"
    other.mkdir()
    assert engine.cleanup() == {"orphaned_chunks": 0, "stale_embeddings": 0}
    assert other.exists() and len([p for p in (tmp_path / "default").iterdir() if p.name.startswith("segment-")]) == 2
    assert int(engine.metadata("cleanup_bytes_after")) < int(engine.metadata("cleanup_bytes_before"))
    assert engine.search("cedar").count() == 1 and engine.search("amber").count() == 0
    assert Engine(spark, str(tmp_path)).search("cedar").count() == 1


class Recorder(vector.HashEmbedder):
    def __init__(self, model):
        super().__init__(8, model)
        self.asked = []

    def embed(self, texts):
        self.asked += texts
        return super().embed(texts)


@pytest.mark.parametrize(("model", "query", "passage"), [("embeddinggemma-300m", "task: search result | query: ", "title: none | text: "), ("Qwen3-Embedding", "Instruct: ", "a text"), ("nomic-embed", "search_query: ", "search_document: ")])
def test_variants_get_the_prefix_of_the_model(spark, tmp_path, model, query, passage):
    engine = Engine(spark, str(tmp_path))
    engine.index_documents(_docs(spark, [("c", "a.md", "amber birch")]))
    recorder = Recorder(model)
    engine.embed(vector.HashEmbedder(8, model))
    engine.search_hybrid("amber", recorder, generator=expansion.CannedGenerator("hyde: a text"), hyde=True).count()
    engine.search_hybrid("amber", recorder).count()
    assert recorder.asked[0].startswith(query) and recorder.asked[1].startswith(passage) and recorder.asked[1].endswith("a text")
    assert len([t for t in recorder.asked if t.endswith("amber")]) == 1  # the second time from the cache
    assert X.family_of(model) == spark.range(1).select(X.prompt_family(F.lit(model))).first()[0]


def test_intent_of_a_collection_with_blanks_about_it(spark, tmp_path):
    class Listening:
        def generate(self, prompt, most):
            self.prompt = prompt
            return ""

    (tmp_path / "c").mkdir()
    engine = Engine(spark, str(tmp_path))
    engine.add_collection(str(tmp_path / "c"), context="about trees")
    listening = Listening()
    engine._variants("amber", listening, "", " c ")
    assert "about trees" in listening.prompt


def test_equal_queries_are_one_judgement(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "amber", "relevant": ["a.md"]}\n\t \n{"query": "amber", "relevant": ["b.md", "a.md"]}\n// no\n\t{"query": "birch", "relevant": ["a.md"]}\n')
    rows = {r["query"]: sorted(r["relevant"]) for r in read_qrels(spark, str(tmp_path / "q.jsonl")).collect()}
    assert rows == {"amber": ["a.md", "b.md"], "birch": ["a.md"]}
    engine = Engine(spark, str(tmp_path))
    engine.index_documents(_docs(spark, [("c", "a.md", "amber birch"), ("c", "b.md", "amber")]))
    per_query, summary = engine.benchmark(str(tmp_path / "q.jsonl"))
    assert per_query.count() == 2 and summary.first()["mrr"] == 1.0


def test_chunks_of_a_document(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    text = "# Head\n" + "\n\n".join("amber birch cedar delta " * 60 for _ in range(12))
    engine.index_documents(_docs(spark, [("c", "a.md", text), ("c", "b.md", "x")]))
    rows = engine.chunks_of("c/a.md").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows))) and len(rows) > 1 and rows[0]["start_pos"] == 0 and rows[-1]["end_pos"] == len(text.encode())


def test_a_bucket_is_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "FILE_TOKENS", 5)
    docs = spark.range(400).select(F.col("id").alias("doc_key"), F.lit("common words here").alias("content"), F.lit("").alias("title"))
    index = lexical.build(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together again
    try:
        index.write(str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = lexical.LexicalIndex.read(spark, str(tmp_path / "i"), "simple")
    assert back.corpus.first().asDict() == {"n_docs": 400, "avg_length": 3.0}
    assert back.of_terms(["common"]).postings.count() == 400
    files = back.postings.filter("term = 'common'").select(F.input_file_name()).distinct().count()
    assert files > 1


class Flaky:
    def __init__(self, status, fail):
        self.status, self.left, self.calls = status, fail, 0

    def __call__(self, texts):
        self.calls += 1
        if self.left:
            self.left -= 1
            error = RuntimeError("busy")
            error.status = self.status
            raise error
        return [[float(t)] for t in texts]


def test_remote_embedder(monkeypatch):
    texts = [str(i) for i in range(95)]
    busy = Flaky(429, 2)
    assert vector.RetryingEmbedder(busy, "m", 1, batch=10, pause=0).embed(texts) == [[float(i)] for i in range(95)] and busy.calls == 12
    assert vector.RetryingEmbedder(Flaky(503, 3), "m", 1, batch=7, pause=0, workers=4).embed(texts) == [[float(i)] for i in range(95)]
    wrong = Flaky(400, 1)
    with pytest.raises(RuntimeError):
        vector.RetryingEmbedder(wrong, "m", 1, pause=0).embed(["1"])
    assert wrong.calls == 1
    monkeypatch.setenv("TEXTQUARRY_WORKERS", "20")
    assert (vector.worker_count(), vector.worker_count(3)) == (8, 3)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_with_ties_against_a_plain_loop(spark, metric):
    draw = random.Random(5)
    rows = [(i // 3, i, [float(draw.randint(-2, 2)) for _ in range(3)] if i % 7 else [1.0, 1.0, 0.0]) for i in range(600)]
    rows = [r for r in rows if any(r[2])]
    asked = [(k, r[2]) for k, r in enumerate(rows[:25])]
    got = {}
    for r in vector.nearest(spark.createDataFrame(rows, "doc_key long, chunk_key long, embedding array<float>").repartition(3), asked, 40, metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_key"], r["chunk_key"]))
    import numpy as np

    for k, q in asked:
        best = {}
        for d, c, v in rows:
            a, b = np.array([v], np.float64), np.array(q, np.float64)
            best[d] = min(best.get(d, (9e9, 0)), (float(vector.distances(a, b, metric)[0]), c))
        want = sorted((x, d, c) for d, (x, c) in best.items())[:40]
        assert [d for _, d, _ in sorted(got[k])] == [d for _, d, _ in want] and [c for _, _, c in sorted(got[k])] == [c for _, _, c in want]

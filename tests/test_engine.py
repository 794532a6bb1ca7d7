import pytest

from textquarry.operators import catalog, expansion, rerank, vector
from textquarry.plans.engine import Engine, SearchOptions
from textquarry.streaming import ingest

EMBEDDER = vector.HashEmbedder(16)


@pytest.fixture
def notes(tmp_path):
    folder = tmp_path / "notes"
    (folder / "sub").mkdir(parents=True)
    for name, text in {"auth.md": "# Auth\nTokens are signed by the service.", "rate.md": "# Rate\nThe rate limiter uses a window.", "sub/code.py": "def run():\n    return 'tokens'\n", "skip.bin": "tokens"}.items():
        (folder / name).write_text(text)
    return folder


def test_whole_life_of_an_index(spark, notes, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_collection(str(notes), context="about notes")
    with pytest.raises(catalog.CatalogError):
        engine.add_collection(str(notes))
    assert engine.index() == {"indexed": 3, "updated": 0, "unchanged": 0, "removed": 0}
    hits = engine.search("tokens").orderBy("rank").collect()
    assert {r["path"] for r in hits} == {"auth.md", "sub/code.py"}
    assert all("\x1b[1m" in r["snippet"] for r in hits)
    with pytest.raises(catalog.CatalogError, match="empty"):
        engine.search("-tokens")
    assert engine.search_hybrid("rate").first()["fused_score"] > 0  # no vectors yet

    assert engine.embed(EMBEDDER) == 3
    assert engine.embed(EMBEDDER) == 0
    with pytest.raises(catalog.CatalogError):
        engine.embed(vector.HashEmbedder(16, "other-model"))
    (notes / "auth.md").write_text("# Auth\nEdited tokens.")
    (notes / "rate.md").unlink()
    assert engine.index() == {"indexed": 0, "updated": 1, "unchanged": 1, "removed": 1}
    assert engine.embed(EMBEDDER) == 1
    assert engine.search("rate").count() == 0

    fused = engine.search_hybrid("tokens", EMBEDDER, SearchOptions(limit=5), generator=expansion.CannedGenerator("lex: tokens\nvec: signed\nhyde: a text"), hyde=True, reranker=rerank.OverlapReranker())
    assert {r["path"] for r in fused.collect()} == {"auth.md", "sub/code.py"}
    assert engine.get("auth.md").first()["title"] == "Auth"
    assert engine.get("#" + engine.get("sub/code.py").first()["doc_id"]).first()["title"] == "run"
    assert {r["name"]: r["n"] for r in engine.status().collect()}["documents"] == 2
    assert engine.cleanup() == {"orphaned_chunks": 0, "stale_embeddings": 0}
    assert all(engine.doctor().values())

    again = Engine(spark, str(tmp_path / "index"))
    again.rename_collection("notes", "papers")
    assert {r["name"]: r["doc_count"] for r in again.collections().collect()} == {"papers": 2}
    again.add_context("more", "papers", "sub")
    assert again.contexts().count() == 2
    again.remove_collection("papers")
    assert again.table("documents").count() == 0
    with pytest.raises(catalog.CatalogError):
        Engine(spark, str(tmp_path), "no/name")


def test_streaming_ingest(spark, notes, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    stream = ingest.file_stream(spark, "notes", str(notes))
    ingest.ingest(engine, stream, str(tmp_path / "ck")).awaitTermination()
    assert engine.table("documents").count() == 3
    (notes / "new.md").write_text("# New\nFresh tokens")
    ingest.ingest(engine, ingest.file_stream(spark, "notes", str(notes)), str(tmp_path / "ck")).awaitTermination()
    assert {r["path"] for r in engine.search("tokens").collect()} == {"auth.md", "sub/code.py", "new.md"}

import sqlite3

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as X
from textquarry.operators import catalog, expansion, fusion, lexical, rerank, vector
from textquarry.sources import readers, sinks

TEXTS = {
    1: ("Authentication", "Tokens are signed by the authentication service and rate limits apply."), 2: ("Rate limiting", "The rate limiter uses a sliding window. Rate limits protect services."),
    3: ("Random", "Completely unrelated gardening notes about café roses."), 4: ("API", "The API documents authentication flows, tokens and the limiter rate."),
    5: ("Cooking", "Boil water. Add tokens of salt."), 6: ("", "in memory rate limiter without storage"), 7: ("Window", "window window window"), 8: ("Notes", ""),
}
QUERIES = ["rate", "authentication tokens", '"rate limiter"', "tokens -salt", 'rate -"in memory"', "cafe", "limit window", "the", "unknown", "services rates"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "notes" if k % 2 else "docs", f"{k}.md", t, c, f"{k:06d}") for k, (t, c) in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_key long, collection string, path string, title string, content string, doc_id string")


def test_bm25_equals_fts5(docs):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, content, tokenize='porter unicode61')")
    for k, (t, c) in TEXTS.items():
        con.execute("insert into t(rowid, title, content) values (?, ?, ?)", (k, t, c))
    index = lexical.build(docs, analyzer="porter")
    got = lexical.search(index, list(enumerate(QUERIES)), docs, every=True).collect()
    from textquarry.functions.query_syntax import normalised

    for i, query in enumerate(QUERIES):
        wanted = {r[0]: -r[1] for r in con.execute("select rowid, bm25(t) from t where t match ?", (normalised(query),))}
        ours = {r["doc_key"]: r["score"] for r in got if r["query_id"] == i}
        assert ours == pytest.approx(wanted, abs=1e-9), query


def test_snippet_equals_fts5():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, content, tokenize='porter unicode61')")
    content = "one two three four rate limiter six seven eight"
    con.execute("insert into t values ('x', ?)", (content,))
    row = con.execute("select snippet(t, 1, ?, ?, '...', 15) from t where t match '\"rate limiter\"'", (lexical.MARK, lexical.UNMARK)).fetchone()
    assert lexical.snippet(content, [["rate", "limit"]]) == row[0]
    long = " ".join(f"w{i}" for i in range(60)) + " rate " + " ".join(f"v{i}" for i in range(60))
    cut = lexical.snippet(long, [["rate"]])
    assert cut.startswith("...") and cut.endswith("...") and f"{lexical.MARK}rate{lexical.UNMARK}" in cut


def test_filters_limits_and_hostile_queries(docs):
    index = lexical.build(docs, analyzer="porter")
    only = lexical.search(index, [(0, "rate")], docs, collections="docs, none").collect()
    assert {r["collection"] for r in only} == {"docs"}
    assert lexical.search(index, [(0, "rate")], docs, limit=1).count() == 1
    assert lexical.search(index, [(0, "rate")], docs, min_score=1e9).count() == 0
    for bad in ("? * : (", "AND OR", "-", '"', "NEAR("):
        lexical.search(index, [(0, bad)], docs).count()


def test_nearest_gives_one_chunk_per_document(spark):
    rows = [(k, k // 2, [float(k), 0.0]) for k in range(20)]
    vectors = spark.createDataFrame(rows, "chunk_key long, doc_key long, embedding array<float>").repartition(5)
    hits = vector.nearest(vectors, [(7, [4.0, 0.0])], 3).orderBy("rank").collect()
    assert [(r["doc_key"], r["chunk_key"], r["distance"]) for r in hits] == [(2, 4, 0.0), (1, 3, 1.0), (3, 6, 2.0)]
    assert hits[0]["score"] == 1.0 and hits[1]["score"] == 0.5
    with pytest.raises(Exception, match="must have"):
        vector.nearest(vectors, [(7, [1.0])], 3).collect()
    with pytest.raises(Exception, match="vector has"):
        vector.checked(vectors, 3).collect()
    assert [vector.fetch_size(x) for x in (1, 50, 5000)] == [50, 200, 4096]


def _list(spark, names, query=0):
    return spark.createDataFrame([(query, i + 1, 1.0 - i / 10, "c", n, n, n) for i, n in enumerate(names)], "query_id long, rank int, score double, collection string, path string, doc_id string, title string")


def test_fusion_numbers(spark):
    fused = {r["path"]: r for r in fusion.fuse(_list(spark, ["a", "b", "d"]), _list(spark, ["a", "c"])).collect()}
    assert fused["a"]["fused_score"] == pytest.approx(2 / 61 + 0.05)
    assert set(fused) == {"a", "b", "c", "d"} or all(r["fused_score"] >= 0.4 * fused["a"]["fused_score"] for r in fused.values())
    assert fused["a"]["rank"] == 1 and fused["a"]["bm25_rank"] == fused["a"]["vec_rank"] == 1
    alone = fusion.fuse(_list(spark, ["a"]), _list(spark, ["a"]).limit(0)).first()
    assert alone["fused_score"] == pytest.approx(1 / 61 + 0.05) and alone["vec_rank"] is None


def test_merging_lists(spark):
    one, two = _list(spark, ["a", "b"]), _list(spark, ["b", "c"])
    assert fusion.merge_lists([]) is None
    assert fusion.merge_lists([one]) is one
    merged = {r["path"]: r["score"] for r in fusion.merge_lists([one, two]).collect()}
    assert merged == pytest.approx({"a": 2 / 61, "b": 2 / 62 + 1 / 61, "c": 1 / 62})


def test_rerank_and_blend(spark):
    hits = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate([1.0, 5.0, 3.0])], "query_id long, rank int, logit double")
    assert [r["first_rank"] for r in rerank.reranked(hits).orderBy("rank").collect()] == [2, 3, 1]
    equal = hits.withColumn("logit", F.lit(2.0))
    assert {r["rerank_score"] for r in rerank.reranked(equal).collect()} == {0.5}
    blend = {r["first_rank"]: r["blended_score"] for r in rerank.blended(hits).collect()}
    assert blend == pytest.approx({1: 0.75, 2: 0.75 * 0.5 + 0.25, 3: 0.25 * 0.5})
    texts = spark.createDataFrame([(0, 1, "blue", "a red one"), (0, 2, "blue", "a blue one")], "query_id long, rank int, query string, snippet string")
    assert rerank.reranked(rerank.with_logits(texts, rerank.OverlapReranker())).orderBy("rank").first()["snippet"] == "a blue one"


def test_expansion_lines(spark):
    answer = "lex: rate limits\nlex: unrelated words\nVEC:  how to limit\nhyde: A passage.\nnoise\nodd: x\nvec:\n"
    rows = expansion.variants(spark.createDataFrame([(0, "rate limiter", answer)], "query_id long, query string, answer string")).orderBy("line_no").collect()
    assert [(r["kind"], r["content"]) for r in rows] == [("lex", "rate limits"), ("vec", "how to limit"), ("hyde", "A passage.")]
    assert expansion.automatic_intent("", ["a"], {"a": "about a"}) == "about a"
    assert expansion.automatic_intent("", ["a", "b"], {"a": "x"}) == ""


def test_retrying_embedder():
    calls = []

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    got = vector.RetryingEmbedder(call, "m", 1, batch=2, pause=0).embed(["a", "bb", "ccc"])
    assert got == [[1.0], [2.0], [3.0]] and calls == [2, 2, 1]


def test_sinks(docs, tmp_path):
    hits = docs.filter("doc_key <= 2").select("*", F.col("doc_key").cast("int").alias("rank"), F.lit(0.51239).alias("score"), F.lit("\x1b[1mx\x1b[0m y").alias("snippet"))
    assert '"score":0.51239' in sinks.render(hits, "json") and "\x1b" not in sinks.render(hits, "json")
    assert sinks.render(hits, "csv").splitlines()[1] == "000001,Authentication,notes,1.md,0.5124,x y"
    assert "<result>" in sinks.render(hits, "xml") and "## Authentication" in sinks.render(hits, "md")
    assert sinks.render(hits, "files").splitlines()[0] == "000001,0.5124,notes/1.md,notes"
    assert sinks.render(hits.limit(0)) == "No results."
    assert sinks.chosen_format({"md", "csv"}) == "csv" and sinks.default_limit("md") == 5 and sinks.default_limit("xml") == 20
    for fmt in ("json", "csv", "xml", "md", "files"):
        sinks.write(hits, str(tmp_path / fmt), fmt)


def test_judgements(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('# note\n// note\n\n{"query": "a", "relevant": ["x", "y"]}\n')
    assert [(r["query"], r["relevant"]) for r in readers.read_qrels(spark, str(good)).collect()] == [("a", ["x", "y"])]
    for line in ('{"query": "", "relevant": ["x"]}', '{"query": "a", "relevant": []}', "{broken"):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(line + "\n")
        with pytest.raises(Exception, match="not a judgement"):
            readers.read_qrels(spark, str(bad)).collect()


def test_contexts(spark):
    empty = spark.createDataFrame([], "collection string, path string, context string")
    twice = catalog.set_context(catalog.set_context(empty, None, "/", "old"), None, "/", "new")
    assert [r["context"] for r in twice.collect()] == ["new"]
    with pytest.raises(catalog.CatalogError):
        catalog.remove_context(empty, "a", "/")
    names = spark.createDataFrame([("a", "/a", "*", None)], "name string, root string, glob string, context string")
    assert catalog.undescribed(names, twice).count() == 0 and catalog.undescribed(names, empty).count() == 1


def test_lookup(docs):
    rows = docs.withColumn("doc_id", X.short_id(X.content_hash(F.col("content"))))
    assert catalog.by_path(rows, "docs/2.md").first()["doc_key"] == 2
    assert catalog.by_path(rows, "3.md").first()["doc_key"] == 3
    assert [r["doc_key"] for r in catalog.many(rows, "1.md, missing.md,2.md").orderBy("doc_key").collect()] == [1, 2]
    assert catalog.many(rows, "notes/*.md").count() == 4
    assert catalog.suggestions(rows, "3.txt").first()["doc_key"] == 3

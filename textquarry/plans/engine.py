"""The engine: one index folder with its catalog, chunks, postings and vectors, and every search over it.

Documents, chunks and postings live in segments. A change writes one segment
with what is new and the keys of the documents that are gone; a row counts as
long as no later segment names its key. When there are more than MOST_SEGMENTS,
they are merged, without reading a text again. Every change ends with a new state
file, `state-<version>.json`, put in place by one rename: readers take the
highest version that is there, and never meet a half-written table. A writer
that finds its version taken stops with an error.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import chunking, globs
from textquarry.functions import text as X
from textquarry.functions.query_syntax import split_collections
from textquarry.operators import catalog, evaluation, expansion, fusion, lexical, rerank, vector
from textquarry.sources.readers import read_folder, read_qrels

SCHEMAS = {
    "collections": "name string, root string, glob string, context string",
    "contexts": "collection string, path string, context string",
    "documents": "collection string, path string, absolute_path string, content string, updated_at timestamp, content_hash string, doc_id string, title string, doc_key long",
    "chunks": "doc_key long, seq int, start_pos int, end_pos int, text string, content_hash string, chunk_key long, collection string, path string",
    "embeddings": "chunk_key long, doc_key long, text_hash string, embedding array<float>",
}
SEGMENTED = ("documents", "chunks")
MOST_SEGMENTS = 8
#: Folders that no state names are left alone for so long: a writer may be about to commit them.
UNKNOWN_SECONDS = 24 * 3600
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_STATE = re.compile(r"state-([0-9]{9})\.json")
_DEAD = "doc_key long, gone_at int"


@dataclass(frozen=True)
class SearchOptions:
    limit: int | None = None
    collections: str | None = None
    min_score: float = 0.0
    metric: str = "l2"


class Engine:
    """Collections of texts, indexed and searched."""

    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        if not _NAME.fullmatch(name):
            raise catalog.CatalogError(f"not an index name: {name}")
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}"
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._state = self._load()
        self._caches: dict[tuple[str, int], Callable[[str], tuple[float, ...]]] = {}

    # --- storage

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _versions(self) -> list[str]:
        """Names of the state files, newest first."""
        if not self._fs.exists(self._path("")):
            return []
        names = [e.getPath().getName() for e in self._fs.listStatus(self._path(""))]
        return sorted((n for n in names if _STATE.fullmatch(n)), reverse=True)

    def _read_state(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])

    def _load(self) -> dict:
        for name in self._versions()[:1]:
            return self._read_state(name)
        return {"version": 0, "tables": {}, "segments": [], "metadata": {"schema_version": "2"}}

    def _commit(self) -> None:
        version = self._state["version"] + 1
        fresh, final = self._path(f".state-{uuid.uuid4().hex}"), self._path(f"state-{version:09d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(self._state | {"version": version}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            self._fs.delete(fresh, False)
            raise catalog.CatalogError(f"version {version} of the index was written by another")
        self._state["version"] = version

    def _put(self, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            place = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{place}")
            self._state["tables"][name] = place
        self._commit()

    def _read(self, place: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{place}/{name}").select(*[f.split()[0] for f in schema.split(", ")])

    def _dead(self) -> DataFrame | None:
        """doc_key and the last segment that says it is gone; None if no segment says so of any."""
        some = [(i, s["place"]) for i, s in enumerate(self._state["segments"]) if s["gone"]]
        if not some:
            return None
        rows = reduce(DataFrame.unionByName, [self._read(p, "gone", "doc_key long").withColumn("gone_at", F.lit(i)) for i, p in some])
        return rows.groupBy("doc_key").agg(F.max("gone_at").alias("gone_at"))

    def _live(self, parts: list[DataFrame]) -> DataFrame:
        """The rows of the segments' tables, in their order, that no later segment has put away."""
        rows = reduce(DataFrame.unionByName, [t.withColumn("__segment", F.lit(i)) for i, t in enumerate(parts)])
        dead = self._dead()
        if dead is not None:
            gone = dead.withColumnRenamed("doc_key", "__gone")
            rows = rows.join(gone, (rows["doc_key"] == gone["__gone"]) & (rows["__segment"] < gone["gone_at"]), "left_anti")
        return rows.drop("__segment")

    def table(self, name: str) -> DataFrame:
        schema, segments = SCHEMAS[name], self._state["segments"]
        if name in SEGMENTED and segments:
            return self._live([self._read(s["place"], name, schema) for s in segments])
        place = self._state["tables"].get(name)
        if place is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{place}").select(*[f.split()[0] for f in schema.split(", ")])

    def lexical_index(self) -> lexical.LexicalIndex:
        """The postings of all live documents."""
        segments = self._state["segments"]
        if not segments:
            return lexical.build(self.table("documents"), analyzer="porter")
        read = [[self._read(s["place"], name, schema) for name, schema in lexical.TABLES.items()] for s in segments]
        postings, lengths = (self._live([tables[k] for tables in read]) for k in (0, 1))
        return lexical.LexicalIndex.joined([[postings, lengths, reduce(DataFrame.unionByName, [t[2] for t in read])]], "porter")

    def _add_segment(self, docs: DataFrame, chunks: DataFrame, gone: DataFrame, **tables: DataFrame) -> None:
        """Writes documents and chunks with their postings, puts the documents of the keys `gone` away, and commits."""
        place = f"segment-{uuid.uuid4().hex}"
        at = f"{self.root}/{place}"
        docs.write.partitionBy("collection").parquet(f"{at}/documents")
        chunks.write.partitionBy("collection").parquet(f"{at}/chunks")
        gone.select("doc_key").distinct().write.parquet(f"{at}/gone")
        lexical.build(self._read(place, "documents", SCHEMAS["documents"]), analyzer="porter").write(at)
        out = self._read(place, "gone", "doc_key long")
        n_gone = out.count()
        if n_gone:  # the totals of the documents that are put away are taken off: one row
            lengths = self._live([self._read(s["place"], "lengths", lexical.TABLES["lengths"]) for s in self._state["segments"]])
            off = lengths.join(out, "doc_key", "left_semi").agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("total_length"))
            off.write.mode("append").parquet(f"{at}/corpus")
            self._state["metadata"]["vectors_complete"] = ""
        self._state["segments"].append({"place": place, "gone": n_gone})
        self._put(**tables)
        if len(self._state["segments"]) > MOST_SEGMENTS:
            self.merge()

    def merge(self, strategy: str | None = None) -> None:
        """Writes all live rows as one segment; with a strategy, documents are cut into chunks anew."""
        if not self._state["segments"]:
            return
        place = f"segment-{uuid.uuid4().hex}"
        at = f"{self.root}/{place}"
        docs = self.table("documents")
        docs.write.partitionBy("collection").parquet(f"{at}/documents")
        chunks = self.table("chunks") if strategy is None else self.chunked(docs, strategy)
        chunks.write.partitionBy("collection").parquet(f"{at}/chunks")
        docs.select("doc_key").limit(0).write.parquet(f"{at}/gone")
        self.lexical_index().write(at)
        self._state["segments"] = [{"place": place, "gone": 0}]
        self._commit()

    def metadata(self, key: str) -> str | None:
        return self._state["metadata"].get(key)

    def set_metadata(self, key: str, value: str) -> None:
        self._state["metadata"][key] = value
        self._commit()

    # --- collections and contexts

    def add_collection(self, root: str, name: str = "", glob: str = globs.DEFAULT_GLOB, context: str | None = None) -> None:
        self._put(collections=catalog.add_collection(self.table("collections"), name, root, glob, context))

    def _none(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def remove_collection(self, name: str) -> None:
        collections, _ = catalog.remove_collection(name, self.table("collections"), self.table("documents"))
        gone = self.table("documents").filter(F.col("collection") == name)
        self._add_segment(self._none("documents"), self._none("chunks"), gone, collections=collections)

    def rename_collection(self, old: str, new: str) -> None:
        """Documents get new keys with the new name; their vectors go with them."""
        mine = F.col("collection") == old
        before, chunks = self.table("documents").filter(mine), self.table("chunks").filter(mine)
        collections, docs, renamed = catalog.rename_collection(old, new, self.table("collections"), before, chunks)
        complete = self._state["metadata"].get("vectors_complete", "")
        self._add_segment(docs, renamed, before, collections=collections, embeddings=catalog.moved_vectors(self.table("embeddings"), chunks, renamed))
        if complete:
            self.set_metadata("vectors_complete", complete)

    def collections(self) -> DataFrame:
        return catalog.list_collections(self.table("collections"), self.table("documents"))

    def add_context(self, context: str, collection: str | None = None, path: str = "/") -> None:
        self._put(contexts=catalog.set_context(self.table("contexts"), collection, path, context))

    def remove_context(self, collection: str | None = None, path: str = "/") -> None:
        self._put(contexts=catalog.remove_context(self.table("contexts"), collection, path))

    def contexts(self) -> DataFrame:
        return catalog.list_contexts(self.table("contexts"), self.table("collections"))

    def undescribed(self) -> DataFrame:
        return catalog.undescribed(self.table("collections"), self.table("contexts"))

    # --- indexing

    def index(self, strategy: str = "auto") -> dict[str, int]:
        """Reads every collection again and brings documents, chunks and postings up to date."""
        rows = self.table("collections").collect()  # the user's own list of folders
        found = None
        for c in rows:
            one = read_folder(self.spark, c["name"], c["root"], c["glob"])
            found = one if found is None else found.unionByName(one)
        return self.index_documents(found, strategy) if found is not None else dict.fromkeys(("indexed", "updated", "unchanged", "removed"), 0)

    def index_documents(self, found: DataFrame, strategy: str = "auto") -> dict[str, int]:
        """The same for a snapshot (collection, path, absolute_path, content, updated_at) from anywhere; what it does not name is removed."""
        return self._changed(found, self.table("documents"), strategy)

    def upsert_documents(self, found: DataFrame, strategy: str = "auto") -> dict[str, int]:
        """Adds and updates the documents of found; all others stay as they are and are not read again."""
        return self._changed(found, self.table("documents").join(found.select(*catalog.KEY), catalog.KEY, "left_semi"), strategy)

    def _changed(self, found: DataFrame, known: DataFrame, strategy: str) -> dict[str, int]:
        fresh = catalog.described(found).select(*[f.split()[0] for f in SCHEMAS["documents"].split(", ")])
        changes = catalog.reconcile(fresh, known).persist()
        counts = catalog.counters(changes).first().asDict()
        if counts["indexed"] + counts["updated"] + counts["removed"]:
            renew = fresh.join(changes.filter("status in ('indexed', 'updated')").select(*catalog.KEY), catalog.KEY, "left_semi")
            gone = changes.filter("status in ('updated', 'removed')").select(catalog.doc_key().alias("doc_key"))
            self._add_segment(renew, self.chunked(renew, strategy), gone)
        changes.unpersist()
        return counts

    def chunked(self, docs: DataFrame, strategy: str) -> DataFrame:
        pieces = docs.select("doc_key", "collection", "path", F.explode(chunking.chunks_of(F.col("content"), F.col("path"), strategy)).alias("c"))
        return pieces.select("doc_key", "c.seq", "c.start_pos", "c.end_pos", F.col("c.text").alias("text"), X.content_hash(F.col("c.text")).alias("content_hash"), "collection", "path").withColumn("chunk_key", catalog.chunk_key())

    def rechunk(self, strategy: str = "auto") -> None:
        """Cuts every document again, by another strategy."""
        self._state["metadata"]["vectors_complete"] = ""
        self.merge(strategy)

    def drop_embeddings(self, path: str | None = None) -> None:
        """Forgets all vectors, or those of the documents at one path."""
        vectors = self.table("embeddings")
        gone = self.table("documents").filter(F.col("path") == path).select("doc_key") if path else vectors.select("doc_key")
        self._put(embeddings=vectors.join(gone.distinct(), "doc_key", "left_anti"))
        if path is None:
            self._state["metadata"].pop("embedding_model", None)
            self._commit()

    def embed(self, embedder: vector.Embedder, force: bool = False) -> int:
        """Embeds the chunks that no vector stands for yet, all of them with force; returns how many."""
        catalog.check_model(self.metadata("embedding_model"), embedder.model, force)
        titles = self.table("documents").select("doc_key", "title")
        prompt = X.capped(X.document_prompt(X.prompt_family(F.lit(embedder.model)), F.col("title"), F.col("text")))
        chunks = self.table("chunks").join(titles, "doc_key").withColumn("prompt", prompt).withColumn("text_hash", X.content_hash(F.concat_ws("\x00", F.lit(embedder.model), F.col("prompt"))))
        old = self.table("embeddings").limit(0) if force else self.table("embeddings")
        todo = vector.needing_embedding(chunks.select("text_hash", "prompt").dropDuplicates(["text_hash"]), old)
        made = vector.embed_texts(todo, embedder).select("text_hash", "embedding").persist()
        count = made.count()
        by_hash = old.select("text_hash", "embedding").dropDuplicates(["text_hash"]).unionByName(made)
        self._put(embeddings=chunks.select("chunk_key", "doc_key", "text_hash").join(by_hash, "text_hash").select("chunk_key", "doc_key", "text_hash", "embedding"))
        made.unpersist()
        self._state["metadata"] |= {"embedding_model": embedder.model, "vectors_complete": "yes"}
        self._commit()
        return count

    def bytes(self) -> int:
        """What the index folder holds on disk."""
        return self._fs.getContentSummary(self._path("")).getLength() if self._fs.exists(self._path("")) else 0

    def cleanup(self) -> dict[str, int]:
        """Drops what no document stands behind, merges the segments and deletes what only older versions name.

        The metadata cleanup_bytes_before and cleanup_bytes_after tell what it did to the disk.
        """
        before = self.bytes()
        chunks, vectors, stats = catalog.cleanup(self.table("documents"), self.table("chunks"), self.table("embeddings"))
        counts = stats.first().asDict()
        self._put(embeddings=vectors.coalesce(8))
        if counts["orphaned_chunks"] or len(self._state["segments"]) > 1:
            self.merge()
        self._state["metadata"]["vectors_complete"] = "yes"
        self._commit()

        def named(state: dict) -> set[str]:
            return set(state["tables"].values()) | {s["place"] for s in state["segments"]}

        versions = self._versions()
        older = set().union(*[named(self._read_state(v)) for v in versions[1:]])
        live, now = named(self._state), time.time()
        for entry in self._fs.listStatus(self._path("")):
            name = entry.getPath().getName()
            if name in versions[1:] or name not in live and (name in older or (not _STATE.fullmatch(name) and now - entry.getModificationTime() / 1000 > UNKNOWN_SECONDS)):
                self._fs.delete(entry.getPath(), True)
        self._state["metadata"] |= {"cleanup_bytes_before": str(before), "cleanup_bytes_after": str(self.bytes())}
        self._commit()
        return counts

    # --- search

    def _documents(self) -> DataFrame:
        return self.table("documents").select("doc_key", "collection", "path", "doc_id", "title", "content")

    def search_many(self, queries: list[tuple[int, str]], options: SearchOptions = SearchOptions()) -> DataFrame:
        """Lexical hits of many queries, with snippets."""
        if not any(lexical.clause_rows(i, q, "porter") for i, q in queries):
            raise catalog.CatalogError("empty search query")
        index = self.lexical_index()
        terms = lexical.terms_of(queries, "porter")
        if len(terms) <= 1000:  # the buckets of these terms alone are read
            index = index.of_terms(terms)
        hits = lexical.search(index, queries, self._documents(), options.limit, options.collections, options.min_score)
        return lexical.with_snippets(hits, queries, "porter")

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        return self.search_many([(0, query)], options)

    def search_vectors(self, vectors: list[tuple[int, list[float]]], options: SearchOptions = SearchOptions()) -> DataFrame:
        hits = vector.search(self.table("embeddings"), vectors, self._documents(), options.limit, options.collections, options.min_score, options.metric, complete=bool(self.metadata("vectors_complete")))
        texts = self.table("chunks").select("chunk_key", X.head(F.col("text")).alias("snippet"))
        return hits.join(texts, "chunk_key", "left")

    def search_similar(self, query: str, embedder: vector.Embedder, options: SearchOptions = SearchOptions()) -> DataFrame:
        return self.search_vectors([(0, self._query_vector(query, embedder))], options)

    def _query_vectors(self, queries: list[str], embedder: vector.Embedder) -> list[list[float]]:
        prefix = X.QUERY_PREFIX[X.family_of(embedder.model)]
        return [list(v) for v in embedder.embed([prefix + q for q in queries])] if queries else []

    def _query_vector(self, query: str, embedder: vector.Embedder) -> list[float]:
        """The last answers of each model are kept."""
        cached = self._caches.setdefault((embedder.model, embedder.dim), vector.cached_query_vector(embedder))
        return list(cached(X.QUERY_PREFIX[X.family_of(embedder.model)] + query))

    def search_hybrid(self, query: str, embedder: vector.Embedder | None = None, options: SearchOptions = SearchOptions(), generator: expansion.Generator | None = None, intent: str = "", hyde: bool = False, reranker: rerank.Reranker | None = None) -> DataFrame:
        """Lexical and vector ranks fused; with a generator also of query variants, with a reranker blended by position.

        Without vectors or embedder, the lexical ranking alone.
        """
        deep = SearchOptions(fusion.oversample(options.limit), options.collections, 0.0, options.metric)
        if embedder is None or self.table("embeddings").isEmpty():
            return fusion.lexical_only(self.search(query, SearchOptions(options.limit, options.collections, options.min_score)))
        lex, vec = [query], [self._query_vector(query, embedder)]
        if generator is not None:
            for kind, content in self._variants(query, generator, intent, options.collections):
                if kind == "lex":
                    lex.append(content)
                elif kind == "vec":
                    vec.append(self._query_vector(content, embedder))
                elif hyde:
                    vec.append(list(embedder.embed([X.PASSAGE_PREFIX[X.family_of(embedder.model)] + content])[0]))
        lexical_lists = [self.search(q, deep) for q in lex if lexical.clause_rows(0, q, "porter")]
        vector_lists = [self.search_vectors([(0, v)], deep) for v in vec]
        columns = ["query_id", "rank", "score", "collection", "path", "doc_id", "title", "snippet"]
        merged = [fusion.merge_lists([x.select(*columns) for x in lists]) for lists in (lexical_lists, vector_lists)]
        if merged[0] is None:
            merged[0] = merged[1].limit(0)
        fused = fusion.fuse(*merged).withColumn("score", F.col("fused_score"))
        if reranker is not None:
            scored = rerank.blended(rerank.with_logits(fused.withColumn("query", F.lit(query)), reranker, strict=False))
            fused = scored.withColumn("score", F.col("blended_score"))
        limited = fused.filter(F.col("rank") <= options.limit) if options.limit else fused
        return limited.filter(F.col("score") >= options.min_score)

    def _variants(self, query: str, generator: expansion.Generator, intent: str, collections: str | None) -> list[tuple[str, str]]:
        known = {r["name"]: r["context"] or "" for r in self.table("collections").collect()}
        names = split_collections(collections)
        answer = generator.generate(expansion.prompt_for(query, expansion.automatic_intent(intent, names, known)), expansion.ANSWER_TOKENS)
        rows = expansion.variants(self.spark.createDataFrame([(0, query, answer)], "query_id long, query string, answer string"))
        return [(r["kind"], r["content"]) for r in rows.orderBy("line_no").collect()]

    def benchmark(self, qrels_path: str, mode: str = "bm25", embedder: vector.Embedder | None = None, limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """Metrics of each judged query and their macro averages; mode is bm25, vector or hybrid.

        The judged queries, a file that people write, run as one batch.
        """
        if mode not in ("bm25", "vector", "hybrid"):
            raise catalog.CatalogError(f"no mode {mode}: bm25, vector or hybrid")
        qrels = read_qrels(self.spark, qrels_path).persist()
        asked = [(r["query_id"], r["query"]) for r in qrels.select("query_id", "query").collect()]
        options = SearchOptions(limit)
        columns = ["query_id", "rank", "score", "collection", "path", "doc_id"]
        lists = []
        if mode != "vector":
            lists.append(self.search_many(asked, options).select(*columns))
        if mode != "bm25":
            vectors = self._query_vectors([q for _, q in asked], embedder)
            lists.append(self.search_vectors([(i, v) for (i, _), v in zip(asked, vectors, strict=True)], options).select(*columns))
        hits = lists[0] if len(lists) == 1 else fusion.fuse(*lists).filter(F.col("rank") <= limit)
        rows = evaluation.metrics(evaluation.identifiers(hits), qrels)
        return rows, evaluation.summary(rows)

    # --- lookup

    def get(self, spec: str) -> DataFrame:
        return catalog.by_id(self.table("documents"), spec) if spec.startswith("#") else catalog.by_path(self.table("documents"), spec)

    def get_many(self, spec: str, max_bytes: int = 0) -> DataFrame:
        return catalog.many(self.table("documents"), spec, max_bytes)

    def suggestions(self, spec: str) -> DataFrame:
        return catalog.suggestions(self.table("documents"), spec)

    def list_paths(self, collection: str, prefix: str = "") -> DataFrame:
        return catalog.paths_of(self.table("documents"), collection, prefix)

    def chunks_of(self, path: str) -> DataFrame:
        """The chunks of the document at `collection/path` or path, in their order."""
        docs = catalog.by_path(self.table("documents"), path).select("doc_key")
        return self.table("chunks").join(docs, "doc_key", "left_semi").orderBy("collection", "path", "seq")

    def status(self) -> DataFrame:
        return catalog.status(self.table("documents"), self.table("chunks"), self.table("embeddings"))

    def doctor(self) -> dict[str, bool]:
        """Whether every table can be read and every collection's folder is there."""
        out = {f"table {name}": self.table(name).limit(1).count() >= 0 for name in SCHEMAS}
        for c in self.table("collections").collect():
            place = self.spark._jvm.org.apache.hadoop.fs.Path(c["root"])
            out[f"folder {c['name']}"] = bool(place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place))
        return out

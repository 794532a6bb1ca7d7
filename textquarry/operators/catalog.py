"""The catalog: collections, contexts, reconciling a snapshot with the index, lookup and cleanup.

Tables are immutable snapshots. Every change is a DataFrame of the new state, so
the same functions serve a small catalog and a very large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import globs
from textquarry.functions import text as X

KEY = ["collection", "path"]
SUGGESTIONS = 5


class CatalogError(ValueError):
    """A name that is taken, unknown, or a model that does not fit the index."""


def described(docs: DataFrame) -> DataFrame:
    """collection, path, content with content_hash, doc_id, title and doc_key."""
    path, content = F.col("path"), F.col("content")
    digest = X.content_hash(content)
    return docs.withColumns({"content_hash": digest, "doc_id": X.short_id(digest), "title": X.title(content, path), "doc_key": doc_key()})


def doc_key() -> Column:
    return F.xxhash64("collection", "path")


def chunk_key() -> Column:
    return F.xxhash64("doc_key", "seq", "text")


def reconcile(found: DataFrame, known: DataFrame) -> DataFrame:
    """collection, path, status: what each document of the snapshot `found` means for the index `known`.

    Both have collection, path and content_hash; what was not found is removed.
    """
    new = found.select(*KEY, F.col("content_hash").alias("new_hash"))
    old = known.select(*KEY, F.col("content_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "indexed").when(F.col("new_hash").isNull(), "removed").when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("updated")
    return new.join(old, KEY, "full_outer").select(*KEY, status.alias("status"))


def counters(changes: DataFrame) -> DataFrame:
    """One row: indexed, updated, unchanged, removed."""
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "updated", "unchanged", "removed")])


def apply_changes(rows: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """rows of unchanged documents and the fresh rows of the others (both keyed by collection and path)."""
    keep = changes.filter("status = 'unchanged'").select(*KEY)
    renew = changes.filter("status in ('indexed', 'updated')").select(*KEY)
    return rows.join(keep, KEY, "left_semi").unionByName(fresh.join(renew, KEY, "left_semi"))


def missing(known: DataFrame, found: DataFrame) -> DataFrame:
    """Documents of the index that the snapshot no longer has."""
    return known.join(found.select(*KEY), KEY, "left_anti")


def list_collections(collections: DataFrame, docs: DataFrame) -> DataFrame:
    """Every collection with doc_count and last_indexed_at, empty ones too."""
    counted = docs.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("doc_count"), F.max("updated_at").alias("last_indexed_at"))
    return collections.join(counted, "name", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)).cast("long"))


def add_collection(collections: DataFrame, name: str, root: str, glob: str = globs.DEFAULT_GLOB, context: str | None = None) -> DataFrame:
    name = name or root.rstrip("/").rpartition("/")[2]
    if not collections.filter(F.col("name") == name).isEmpty():
        raise CatalogError(f"collection {name} exists")
    spark = collections.sparkSession
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(root).alias("root"), F.lit(glob).alias("glob"), F.lit(context or None).cast("string").alias("context"))
    return collections.unionByName(row)


def remove_collection(name: str, collections: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The catalog and every table without the collection."""
    if collections.filter(F.col("name") == name).isEmpty():
        raise CatalogError(f"no collection {name}")
    return [collections.filter(F.col("name") != name), *[t.filter(F.col("collection") != name) for t in tables]]


def rename_collection(old: str, new: str, collections: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    if collections.filter(F.col("name") == old).isEmpty():
        raise CatalogError(f"no collection {old}")
    if not collections.filter(F.col("name") == new).isEmpty():
        raise CatalogError(f"collection {new} exists")

    def renamed(rows: DataFrame, column: str) -> DataFrame:
        """The keys follow the name, so a new collection of the old name meets none of them."""
        mine = F.col(column) == old
        rows = rows.withColumn("__mine", mine).withColumn(column, F.when(mine, new).otherwise(F.col(column)))
        for key, made in (("doc_key", doc_key()), ("chunk_key", chunk_key())):
            if key in rows.columns and column == "collection":
                rows = rows.withColumn(key, F.when(F.col("__mine"), made).otherwise(F.col(key)))
        return rows.drop("__mine")

    return [renamed(collections, "name"), *[renamed(t, "collection") for t in tables]]


def moved_vectors(vectors: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """vectors whose keys follow those of renamed chunks: old and new are the same chunks before and after."""
    place = ["path", "seq", "start_pos"]
    moved = old.select(*place, F.col("chunk_key").alias("__old")).join(new.select(*place, F.col("chunk_key").alias("__chunk"), F.col("doc_key").alias("__doc")), place).drop(*place)
    both = vectors.join(moved, vectors["chunk_key"] == moved["__old"], "left")
    return both.withColumns({"chunk_key": F.coalesce("__chunk", "chunk_key"), "doc_key": F.coalesce("__doc", "doc_key")}).select(*vectors.columns)


def set_context(contexts: DataFrame, collection: str | None, path: str, context: str) -> DataFrame:
    """contexts with one entry per (collection, path); no collection means all of them."""
    row = contexts.sparkSession.range(1).select(F.lit(collection).cast("string").alias("collection"), F.lit(path).alias("path"), F.lit(context).alias("context"))
    return contexts.filter(~(F.col("collection").eqNullSafe(F.lit(collection)) & (F.col("path") == path))).unionByName(row)


def remove_context(contexts: DataFrame, collection: str | None, path: str) -> DataFrame:
    here = F.col("collection").eqNullSafe(F.lit(collection)) & (F.col("path") == path)
    if contexts.filter(here).isEmpty():
        raise CatalogError(f"no context for {collection or '/'} {path}")
    return contexts.filter(~here)


def list_contexts(contexts: DataFrame, collections: DataFrame) -> DataFrame:
    """Path contexts and the collections' own, by collection and path."""
    own = collections.filter("context is not null and context <> ''").select(F.col("name").alias("collection"), F.lit("/").alias("path"), "context")
    return contexts.select(F.coalesce("collection", F.lit("")).alias("collection"), "path", "context").unionByName(own).orderBy("collection", "path")


def undescribed(collections: DataFrame, contexts: DataFrame) -> DataFrame:
    """Names of collections that no context covers; a global context covers all."""
    everywhere = contexts.filter("collection is null").select(F.lit(True).alias("__any")).limit(1)
    named = collections.join(contexts.filter("collection is not null").select(F.col("collection").alias("name")), "name", "left_anti")
    return named.join(F.broadcast(everywhere), F.lit(True), "left_anti").select("name").orderBy("name")


def cleanup(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of known documents, vectors of those chunks, and one row: orphaned_chunks, stale_embeddings."""
    live_chunks = chunks.join(docs.select("doc_key"), "doc_key", "left_semi")
    live_vectors = vectors.join(live_chunks.select("chunk_key"), "chunk_key", "left_semi")
    orphans = chunks.join(docs.select("doc_key"), "doc_key", "left_anti").agg(F.count("*").alias("orphaned_chunks"))
    stale = vectors.join(live_chunks.select("chunk_key"), "chunk_key", "left_anti").agg(F.count("*").alias("stale_embeddings"))
    return live_chunks, live_vectors, orphans.crossJoin(F.broadcast(stale))  # one row each


def by_id(docs: DataFrame, doc_id: str) -> DataFrame:
    """The document with this short id, the first by place if several share it."""
    return docs.filter(F.col("doc_id") == doc_id.removeprefix("#")).orderBy(*KEY).limit(1)


def by_path(docs: DataFrame, path: str) -> DataFrame:
    """`collection/path` first, else the path in any collection."""
    full = F.concat_ws("/", "collection", "path") == path
    return docs.filter(full | (F.col("path") == path)).orderBy(F.when(full, 0).otherwise(1), *KEY).limit(1)


def matching(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents whose `collection/path` or path fits a glob."""
    return docs.filter(globs.matches(F.concat_ws("/", "collection", "path"), pattern) | globs.matches(F.col("path"), pattern)).orderBy(*KEY)


def many(docs: DataFrame, spec: str, max_bytes: int = 0) -> DataFrame:
    """A glob, or a comma-separated list of paths and #ids whose unknown entries are skipped."""
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if len(parts) <= 1 and globs.has_pattern(spec):
        found = matching(docs, spec)
    else:
        picked = [by_id(docs, p) if p.startswith("#") else by_path(docs, p) for p in parts] or [docs.limit(0)]
        found = picked[0]
        for one in picked[1:]:
            found = found.unionByName(one)
    return found.filter(F.octet_length("content") <= max_bytes) if max_bytes > 0 else found


def suggestion_score(path: Column, wanted: str) -> Column:
    needle = wanted.removeprefix("#").lower()
    base = needle.rpartition("/")
    needle = base[0] + base[1] + (base[2].rpartition(".")[0] if "." in base[2] else base[2])
    low, own = F.lower(path), X.stem(F.lower(path))
    return F.when(own == needle, 100).when(F.contains(own, F.lit(needle)), 60).when(F.contains(low, F.lit(needle)), 30).otherwise(0)


def suggestions(docs: DataFrame, wanted: str, most: int = SUGGESTIONS) -> DataFrame:
    """The documents whose names come nearest to what was asked for."""
    scored = docs.withColumn("likeness", suggestion_score(F.col("path"), wanted)).filter("likeness > 0")
    return scored.orderBy(F.desc("likeness"), *KEY).limit(most)


def paths_of(docs: DataFrame, collection: str, prefix: str = "") -> DataFrame:
    rows = docs.filter(F.col("collection") == collection)
    return (rows.filter(F.col("path").startswith(prefix)) if prefix else rows).select("collection", "path", "doc_id").orderBy("path")


def status(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """name, n for the tables, and for each collection's documents."""
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in (("documents", docs), ("chunks", chunks), ("embeddings", vectors))]
    each = docs.groupBy(F.concat(F.lit("collection:"), F.col("collection")).alias("name")).agg(F.count("*").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(each)


def check_model(recorded: str | None, current: str, force: bool = False) -> None:
    """Vectors of two models must not mix."""
    if recorded and recorded != current and not force:
        raise CatalogError(f"the index holds vectors of {recorded}, not {current}; embed again with force")

"""Registered queries of the engine's own operators, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import analyze, chunking, globs
from textquarry.functions import text as X
from textquarry.operators import catalog, evaluation, expansion, fusion, lexical, rerank, vector
from textquarry.sources import sinks
from textquarry.sources.readers import corpus_columns

FLAGSHIP = "x03_hybrid_search"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TERMS = ("with", "re")
SEARCHES = [(1, "with re"), (2, "with -er"), (3, "er on"), (4, '"of the"')]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from textquarry.plans import change_queries  # noqa: F401  it adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries() if name in _SQL}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as collection, path, content, doc_key, doc_id, title."""
    rows = corpus_columns(_docs(spark, sf_dir))
    return rows.withColumns({"doc_id": X.short_id(X.content_hash(F.col("content"))), "title": X.stem(F.col("path"))})


_CORPUS = "corpus AS (SELECT doc_id AS doc_key, source AS collection, lang || '/' || doc_id || '.md' AS path, text AS content, left(sha256(text), 6) AS doc_id FROM documents)"


# --- scans and projections


@query("SELECT doc_id AS doc_key, sha256(text) AS content_hash, left(sha256(text), 6) AS doc_id FROM documents")
def f01_hash_and_id(spark, sf_dir):
    digest = X.content_hash(F.col("text"))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("doc_key"), digest.alias("content_hash"), X.short_id(digest).alias("doc_id"))


@query(f"WITH {_CORPUS} SELECT doc_key, collection, path, length(content) AS n_chars, doc_id FROM corpus")
def s04_corpus_scan(spark, sf_dir):
    return _corpus(spark, sf_dir).select("doc_key", "collection", "path", F.length("content").cast("long").alias("n_chars"), "doc_id")


def _body_sql(content: str) -> str:
    """CTEs up to body (doc_id, b): content without a closed leading block between --- or +++ lines."""
    return rf"""src AS (SELECT doc_id, {content} AS s FROM documents), lead_ AS (SELECT *, regexp_replace(s, '\A[ \t\r\n]*', '') AS t FROM src),
mark_ AS (SELECT *, CASE WHEN regexp_matches(t, '\A(---|\+\+\+)\r?\n') THEN left(t, 3) END AS mark, regexp_replace(substr(t, 4), '\A[\r\n]*', '') AS rest FROM lead_),
body AS (SELECT doc_id, CASE WHEN mark IS NULL OR instr(rest, chr(10) || mark) = 0 THEN s ELSE regexp_replace(substr(rest, instr(rest, chr(10) || mark) + 4), '\A[\r\n]*', '') END AS b FROM mark_)"""


_TITLED = "CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'tags: x' || chr(10) || '---' || chr(10) || chr(10) || '# ' || split_part(text, '.', 1) || chr(10) || text ELSE text END"


@query(rf"WITH {_body_sql(_TITLED)} SELECT doc_id, coalesce(nullif(regexp_extract(b, '(?m)^[ \t]*# [ \t]*(\S[^\n]*?)[ \t\r]*$', 1), ''), doc_id::VARCHAR) AS title FROM body")
def f03_titles(spark, sf_dir):
    """Titles of all documents, every third one with front matter and a heading put before it."""
    docs = _docs(spark, sf_dir)
    first = F.split_part("text", F.lit("."), F.lit(1))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntags: x\n---\n\n# "), first, F.lit("\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", X.title(content, F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"))


_CODE_SPARK = {
    0: ("go", "package p{i}\n\nfunc (r *T) helper() {{}}\n\nfunc Find{i}(x int) int {{\n}}\n"),
    1: ("py", "import os\n\nasync def find_{i}(x):\n    pass\n"),
    2: ("ts", "function inner() {{}}\nexport default class Box{i} {{}}\n"),
    3: ("java", "package a;\npublic final class Box{i} {{\n}}\n"),
    4: ("rs", "fn inner() {{}}\n  pub struct Box{i};\n"),
    5: ("go", "// nothing here\nfunc lower{i}() {{}}\n"),
}


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'package p' || event_id || ' — Find' || event_id WHEN 1 THEN 'find_' || event_id WHEN 2 THEN 'Box' || event_id
WHEN 3 THEN 'Box' || event_id WHEN 4 THEN 'Box' || event_id ELSE '' END AS title FROM events""")
def f04_code_titles(spark, sf_dir):
    number = F.col("event_id").cast("string")
    content, path = F.lit(""), F.lit("")
    for k, (ext, body) in _CODE_SPARK.items():
        here = F.col("event_id") % 6 == k
        content = F.when(here, F.replace(F.lit(body.format(i="@")), F.lit("@"), number)).otherwise(content)
        path = F.when(here, F.lit(f"src/file.{ext}")).otherwise(path)
    return _table(spark, sf_dir, "events").select("event_id", X.code_title(content, path).alias("title"))


_FRONTED = "CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || text WHEN 1 THEN '+++' || chr(10) || 'a = 1' || chr(10) || '+++' || chr(10) || chr(10) || text WHEN 2 THEN '---' || chr(10) || 'unclosed' || text ELSE text END"


@query(f"WITH {_body_sql(_FRONTED)} SELECT doc_id, length(b) AS n_chars FROM body")
def f05_frontmatter(spark, sf_dir):
    """Lengths without front matter, of which three kinds are put before the texts."""
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.lit("---\na: 1\n---\n"), "text")).when(k == 1, F.concat(F.lit("+++\na = 1\n+++\n\n"), "text")).when(k == 2, F.concat(F.lit("---\nunclosed"), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(X.strip_frontmatter(content)).cast("long").alias("n_chars"))


_EXTENSIONS = ["md", "TXT", "go", "tsx", "js", "py", "java", "rs", "yaml", "Dockerfile", "sql", "c"]
_LIST = ", ".join(f"'{e}'" for e in _EXTENSIONS)


@query(f"""WITH p AS (SELECT event_id, lower(([{_LIST}])[1 + (event_id % {len(_EXTENSIONS)})]) AS ext FROM events)
SELECT event_id, CASE WHEN ext IN ('md','txt','rst') THEN 'markdown' WHEN ext IN ('go','tsx','js','py','java','rs','c') THEN 'code' WHEN ext IN ('yaml','sql') THEN 'config' ELSE 'text' END AS kind,
CASE ext WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' ELSE '' END AS language FROM p""")
def f06_file_kinds(spark, sf_dir):
    names = F.array(*[F.lit(e) for e in _EXTENSIONS])
    path = F.concat(F.lit("dir.x/f."), F.element_at(names, (F.col("event_id") % len(_EXTENSIONS) + 1).cast("int")))
    return _table(spark, sf_dir, "events").select("event_id", X.file_kind(path).alias("kind"), X.language(path).alias("language"))


@query(r"SELECT doc_id, floor(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE + 0.5)::BIGINT AS tokens FROM documents")
def f08_token_estimates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH s AS (SELECT *, least(greatest(CAST(l_quantity AS DOUBLE) / 40, 0), 1) AS share FROM lineitem) SELECT l_orderkey, l_linenumber, l_linenumber * 10::DOUBLE * (1 - share * share * 0.7::DOUBLE) AS score FROM s""")
def f09_break_scores(spark, sf_dir):
    """Unrounded: both sides compute the same numbers, while rounding them meets ties."""
    score = X.break_score(F.col("l_linenumber") * 10.0, F.col("l_quantity"), F.lit(40.0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


_MARKED = """marked AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS n FROM (SELECT doc_id, string_split(CASE doc_id % 5 WHEN 0 THEN '# Top' || chr(10) || '- item' || chr(10) || text WHEN 1 THEN '---' || chr(10) || '12. x' || chr(10) || '### Deep' || chr(10) || text ELSE text END, chr(10)) AS lines FROM documents))"""


def _marked_lines(spark, sf_dir):
    k = F.col("doc_id") % 5
    content = F.when(k == 0, F.concat(F.lit("# Top\n- item\n"), "text")).when(k == 1, F.concat(F.lit("---\n12. x\n### Deep\n"), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(content, "\n", -1)).alias("n", "line"))


@query(rf"""WITH {_MARKED}, t AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS line FROM marked),
s AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN ([100, 90, 80, 70, 60, 50])[length(regexp_extract(line, '^(#+) ', 1))] WHEN line IN ('---', '***', '- - -') THEN 60 WHEN line = '' THEN 20
WHEN regexp_matches(line, '^(?:[-*+] |[0-9]+\.\s)') THEN 5 WHEN n > 0 THEN 1 ELSE 0 END AS score FROM t)
SELECT doc_id, score::BIGINT AS score, count(*) AS n_lines FROM s GROUP BY ALL""")
def f10_line_scores(spark, sf_dir):
    rows = _marked_lines(spark, sf_dir).select("doc_id", X.line_score(F.col("line"), F.col("n")).cast("long").alias("score"))
    return rows.groupBy("doc_id", "score").agg(F.count("*").alias("n_lines"))


@query("""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || text || chr(10) || '  ~~~' || chr(10) || 'after' ELSE text || chr(10) || '~~~go' || chr(10) || 'open' END, chr(10)) AS lines FROM documents)),
f AS (SELECT doc_id, regexp_matches(ltrim(line, ' ' || chr(9)), '^(?:```|~~~)') AS fence, n FROM l),
r AS (SELECT doc_id, fence, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS inside FROM f)
SELECT doc_id, count(*) FILTER (fence) AS fences, count(*) FILTER (NOT fence AND inside = 1) AS fenced_lines FROM r GROUP BY doc_id""")
def f11_fenced_lines(spark, sf_dir):
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n  ~~~\nafter"))).otherwise(F.concat("text", F.lit("\n~~~go\nopen")))
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(content, "\n", -1)).alias("n", "line")).withColumn("fence", X.is_fence(F.col("line")))
    inside = F.sum(F.col("fence").cast("int")).over(Window.partitionBy("doc_id").orderBy("n")) % 2
    rows = lines.withColumn("inside", inside)
    return rows.groupBy("doc_id").agg(F.count_if("fence").alias("fences"), F.count_if(~F.col("fence") & (F.col("inside") == 1)).alias("fenced_lines"))


@query(r"SELECT item_id, trim(regexp_replace(text, '[^\p{L}\p{Nd}_]+', ' ', 'g')) AS words FROM benchmark")
def f14_bare_words(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", X.bare_words(F.col("text")).alias("words"))


@query("SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src7') GROUP BY lang")
def f16_collection_filter(spark, sf_dir):
    from textquarry.functions.query_syntax import split_collections

    return _docs(spark, sf_dir).filter(F.col("source").isin(split_collections(" src1, src2,,src7 "))).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 240) || '...' ELSE text END AS snippet, CASE WHEN length(text) > 800 THEN left(text, 800) || '…' ELSE text END AS cut, left(text, 4000) AS capped FROM documents""")
def f17_cuts(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.head(text).alias("snippet"), X.truncated(text).alias("cut"), X.capped(text).alias("capped"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[3:5], chr(10)) AS lines FROM documents")
def f19_line_range(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.line_range(F.col("text"), 3, 3).alias("lines"))


@query(f"WITH {_CORPUS} SELECT doc_key, path FROM corpus WHERE regexp_full_match(collection || '/' || path, 'src1[0-4]/(?:en|fr)/[^/]*5.md')")
def f22_glob_match(spark, sf_dir):
    return catalog.matching(_corpus(spark, sf_dir), "src1[0-4]/{en,fr}/*5.md").select("doc_key", "path")


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \t]', ' ', 'g'), '[ \t]+'), lambda x: length(x) > 1) AS q, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \t]', ' ', 'g'), '[ \t]+'), lambda x: x <> '') AS c FROM benchmark)
SELECT a.item_id, list_has_any(b.c, a.q) AS shares FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def f24_shared_tokens(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(after, "item_id").select("item_id", X.shares_token(F.col("other"), F.col("text")).alias("shares"))


@query("""WITH f AS (SELECT *, (['nomic', 'gemma', 'qwen3', 'generic'])[1 + (item_id % 4)] AS family FROM benchmark)
SELECT item_id, CASE family WHEN 'gemma' THEN 'task: search result | query: ' || text WHEN 'qwen3' THEN 'Instruct: Given a query, retrieve relevant passages that answer the query' || chr(10) || 'Query: ' || text WHEN 'generic' THEN text ELSE 'search_query: ' || text END AS query_prompt,
CASE family WHEN 'gemma' THEN 'title: ' || CASE WHEN item_id % 3 = 0 THEN 'none' ELSE 't' || item_id END || ' | text: ' || text WHEN 'nomic' THEN CASE WHEN item_id % 3 = 0 THEN 'search_document: ' || text ELSE 'search_document: t' || item_id || ' — ' || text END ELSE text END AS document_prompt FROM f""")
def f25_prompts(spark, sf_dir):
    families = F.array(*[F.lit(x) for x in ("nomic", "gemma", "qwen3", "generic")])
    family = F.element_at(families, (F.col("item_id") % 4 + 1).cast("int"))
    title = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("t"), F.col("item_id").cast("string")))
    return _table(spark, sf_dir, "benchmark").select("item_id", X.query_prompt(family, F.col("text")).alias("query_prompt"), X.document_prompt(family, title, F.col("text")).alias("document_prompt"))


@query("SELECT coalesce(nullif(lang, 'en'), '') AS lang, count(*) AS n FROM documents GROUP BY 1")
def f28_null_handling(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.coalesce(F.nullif("lang", F.lit("en")), F.lit("")).alias("lang")).agg(F.count("*").alias("n"))


# --- catalog: joins, counts, sets, changes

_COLLECTIONS = "collections AS (SELECT 'src' || n AS name, CASE WHEN n % 3 = 0 THEN 'about ' || n WHEN n % 3 = 1 THEN '' END AS context FROM range(25) t(n))"


def _collections(spark):
    n = F.col("id").cast("string")
    return spark.range(25).select(F.concat(F.lit("src"), n).alias("name"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("about "), n)).when(F.col("id") % 3 == 1, "").alias("context"))


_CONTEXTS = "contexts AS (SELECT 'src' || n AS collection, 'en/' AS path, 'note ' || n AS context FROM range(0, 20, 4) t(n))"


def _contexts(spark):
    n = F.col("id").cast("string")
    return spark.range(0, 20, 4).select(F.concat(F.lit("src"), n).alias("collection"), F.lit("en/").alias("path"), F.concat(F.lit("note "), n).alias("context"))


@query(f"WITH {_COLLECTIONS} SELECT c.name, c.context, count(d.doc_id) AS doc_count, max(d.n_chars) AS last_indexed_at FROM collections c LEFT JOIN documents d ON d.source = c.name GROUP BY ALL")
def g06_list_collections(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("source").alias("collection"), F.col("n_chars").alias("updated_at"))
    return catalog.list_collections(_collections(spark), docs)


@query(f"""WITH {_COLLECTIONS}, {_CONTEXTS} SELECT collection, path, context FROM contexts UNION ALL SELECT name, '/', context FROM collections WHERE context <> ''""")
def u01_list_contexts(spark, sf_dir):
    return catalog.list_contexts(_contexts(spark), _collections(spark))


@query(f"""WITH {_COLLECTIONS}, {_CONTEXTS} SELECT name FROM collections c WHERE NOT EXISTS (SELECT 1 FROM contexts x WHERE x.collection = c.name OR x.collection IS NULL)""")
def j07_undescribed_collections(spark, sf_dir):
    return catalog.undescribed(_collections(spark), _contexts(spark))


_SNAPSHOTS = """old AS (SELECT source AS collection, lang || '/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT source AS collection, lang || '/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)"""


def _snapshots(spark, sf_dir):
    rows = corpus_columns(_docs(spark, sf_dir))
    old = rows.filter("doc_key % 10 <> 0").withColumn("content_hash", X.content_hash(F.col("content")))
    edited = F.when(F.col("doc_key") % 5 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    new = rows.filter("doc_key % 7 <> 0").withColumn("content", edited).withColumn("content_hash", X.content_hash(F.col("content")))
    return old, new


@query(f"""WITH {_SNAPSHOTS} SELECT collection, path, CASE WHEN old.h IS NULL THEN 'indexed' WHEN new.h IS NULL THEN 'removed' WHEN old.h = new.h THEN 'unchanged' ELSE 'updated' END AS status FROM old FULL JOIN new USING (collection, path)""")
def d04_reconcile(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return catalog.reconcile(new, old)


@query(f"""WITH {_SNAPSHOTS} SELECT count(*) FILTER (old.h IS NULL) AS indexed, count(*) FILTER (old.h <> new.h) AS updated, count(*) FILTER (old.h = new.h) AS unchanged, count(*) FILTER (new.h IS NULL) AS removed FROM old FULL JOIN new USING (collection, path)""")
def a09_index_counters(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return catalog.counters(catalog.reconcile(new, old))


@query(f"WITH {_SNAPSHOTS} SELECT collection, path FROM old ANTI JOIN new USING (collection, path)")
def j09_missing_documents(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return catalog.missing(old, new).select("collection", "path")


def _vector_tables(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("doc_key"))
    chunks = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"), F.expr("vec_id div 2").alias("doc_key"))
    return docs, chunks.filter("chunk_key % 11 <> 0"), _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


@query("""WITH d AS (SELECT doc_id AS doc_key FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT vec_id AS chunk_key, vec_id // 2 AS doc_key FROM embeddings WHERE vec_id % 11 <> 0)
SELECT (SELECT count(*) FROM c WHERE doc_key NOT IN (SELECT doc_key FROM d)) AS orphaned_chunks, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT chunk_key FROM c JOIN d USING (doc_key))) AS stale_embeddings""")
def d12_cleanup_counts(spark, sf_dir):
    return catalog.cleanup(*_vector_tables(spark, sf_dir))[2]


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0)")
def j05_needing_embedding(spark, sf_dir):
    chunks = _docs(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("text_hash"))
    return vector.needing_embedding(chunks, chunks.filter("doc_id % 4 <> 0")).select("doc_id", "text_hash")


@query("SELECT vec_id AS chunk_key, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings")
def d07_upsert_vectors(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"))
    return vector.upserted(rows.withColumn("model", F.lit("old")), rows.filter("chunk_key % 5 = 0").withColumn("model", F.lit("new")))


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'chunks', count(*) FROM embeddings WHERE vec_id % 11 <> 0 UNION ALL SELECT 'embeddings', count(*) FROM embeddings
UNION ALL SELECT 'collection:' || source, count(*) FROM documents WHERE doc_id % 3 <> 0 GROUP BY source""")
def g07_status(spark, sf_dir):
    _, chunks, vectors = _vector_tables(spark, sf_dir)
    return catalog.status(_docs(spark, sf_dir).filter("doc_id % 3 <> 0").select(F.col("source").alias("collection")), chunks, vectors)


@query(f"WITH {_CORPUS} SELECT doc_key, collection, path FROM corpus WHERE doc_id = (SELECT doc_id FROM corpus WHERE doc_key = 11) ORDER BY collection, path LIMIT 1")
def g01_get_by_id(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    wanted = docs.filter("doc_key = 11").first()["doc_id"]
    return catalog.by_id(docs, "#" + wanted).select("doc_key", "collection", "path")


@query(f"WITH {_CORPUS} SELECT doc_key, collection, path FROM corpus WHERE path LIKE '%/12.md' UNION ALL SELECT doc_key, collection, path FROM corpus WHERE doc_key = 13")
def g02_get_by_path(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    one, two = (docs.filter(F.col("doc_key") == k).first() for k in (12, 13))
    return catalog.by_path(docs, one["path"]).unionByName(catalog.by_path(docs, f"{two['collection']}/{two['path']}")).select("doc_key", "collection", "path")


@query(f"WITH {_CORPUS} SELECT doc_key, path FROM corpus WHERE regexp_matches(path, '^[de][en]/[^/]*7.md$') AND strlen(content) <= 3000")
def g03_multi_get(spark, sf_dir):
    return catalog.many(_corpus(spark, sf_dir), "[de][en]/*7.md", 3000).select("doc_key", "path")


@query(f"""WITH {_CORPUS}, s AS (SELECT doc_key, collection, path, CASE WHEN regexp_extract(path, '([^/]*)[.]md$', 1) = '12' THEN 100 WHEN contains(regexp_extract(path, '([^/]*)[.]md$', 1), '12') THEN 60 WHEN contains(path, '12') THEN 30 ELSE 0 END AS likeness FROM corpus)
SELECT doc_key, likeness FROM s WHERE likeness > 0 ORDER BY likeness DESC, collection, path LIMIT 5""")
def l08_suggestions(spark, sf_dir):
    return catalog.suggestions(_corpus(spark, sf_dir), "12.md").select("doc_key", "likeness")


@query(f"WITH {_CORPUS} SELECT collection, path, doc_id FROM corpus WHERE collection = 'src3' AND starts_with(path, 'en/')")
def g05_list_paths(spark, sf_dir):
    return catalog.paths_of(_corpus(spark, sf_dir), "src3", "en/")


@query("SELECT source AS collection, count(*) AS n_docs, count(DISTINCT text) AS n_contents, max(n_chars) AS longest FROM documents GROUP BY source")
def a01_collection_counts(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n_docs"), F.count_distinct("text").alias("n_contents"), F.max("n_chars").alias("longest"))


@query("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY first_turn) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY conv_id)")
def u02_ordered_distinct(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


# --- chunks and analyzers


@query("SELECT doc_id AS doc_key, 0::BIGINT AS first_start, strlen(text) AS last_end, 0::BIGINT AS gaps, 0::BIGINT AS bad_seq, 0::BIGINT AS off_line FROM documents WHERE text <> ''")
def t08_chunk_invariants(spark, sf_dir):
    """Chunks cover every document without gaps and begin at line starts."""
    docs = corpus_columns(_docs(spark, sf_dir))
    chunks = chunking.chunk_documents(docs)
    own = Window.partitionBy("doc_key").orderBy("seq")
    rows = chunks.withColumns({"before": F.lag("end_pos").over(own), "number": F.row_number().over(own) - 1})
    joined = rows.join(docs.select("doc_key", F.col("content").cast("binary").alias("raw")), "doc_key")
    at_line = (F.col("start_pos") == 0) | (F.hex(F.expr("substring(raw, start_pos, 1)")) == "0A")
    return joined.groupBy("doc_key").agg(
        F.min("start_pos").cast("long").alias("first_start"), F.max("end_pos").cast("long").alias("last_end"), F.count_if(F.col("start_pos") > F.col("before")).alias("gaps"),
        F.count_if(F.col("seq") != F.col("number")).alias("bad_seq"), F.count_if(~at_line).alias("off_line"),
    )


@query()
def t08_chunks(spark, sf_dir):
    return chunking.chunk_documents(corpus_columns(_docs(spark, sf_dir))).select("doc_key", "seq", "start_pos", "end_pos", "content_hash")


@query()
def t09_code_chunks(spark, sf_dir):
    """Source files made of each document's lines, cut at their functions."""
    line = F.regexp_replace("text", "[^A-Za-z \n]", "")
    body = F.array_join(F.transform(F.split(line, "\n"), lambda x, i: F.concat(F.lit("def part_"), i.cast("string"), F.lit("():\n    return '"), x, F.lit("'\n"))), "\n")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc_key"), body.alias("content"), F.lit("src/made.py").alias("path"))
    return chunking.chunk_documents(docs).select("doc_key", "seq", "start_pos", "end_pos")


@query()
def t01_porter_terms(spark, sf_dir):
    index = lexical.build(corpus_columns(_docs(spark, sf_dir)), fields=("content",), analyzer="porter")
    return index.postings.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_uses"))


_TOKENS = r"tok AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS terms FROM documents))"


@query(f"WITH {_TOKENS} SELECT term, doc_id AS doc_key, count(*) AS tf, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM tok GROUP BY ALL")
def t02_postings(spark, sf_dir):
    index = _simple_index(spark, sf_dir)
    return index.postings.select("term", "doc_key", "tf", F.array_min("positions").cast("long").alias("first_pos"), F.array_max("positions").cast("long").alias("last_pos"))


def _simple_index(spark, sf_dir, asked=None):
    """Postings of the whole corpus, or of the terms that are asked for."""
    terms = lexical.terms_of(asked, "simple") if asked else None
    return lexical.build(corpus_columns(_docs(spark, sf_dir)), fields=("content",), analyzer="simple", only_terms=terms)


def _search(spark, sf_dir, asked, **options):
    return lexical.search(_simple_index(spark, sf_dir, asked), asked, _corpus(spark, sf_dir), **options)


@query(f"WITH {_TOKENS}, l AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT (SELECT count(*) FROM documents) AS n_docs, round((SELECT sum(n) FROM l) / (SELECT count(*) FROM documents), 6) AS avg_length, (SELECT count(DISTINCT term) FROM tok) AS n_terms")
def a08_corpus_statistics(spark, sf_dir):
    index = _simple_index(spark, sf_dir)
    terms = index.postings.agg(F.count_distinct("term").alias("n_terms"))
    return index.corpus.select("n_docs", F.round("avg_length", 6).alias("avg_length")).crossJoin(F.broadcast(terms))  # one row each


# --- lexical search

_BM25 = rf"""{_TOKENS}, len_ AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id),
stat AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len_),
tf AS (SELECT doc_id, term, count(*) AS f FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
part AS (SELECT doc_id, term, (CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6::DOUBLE END) * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS s FROM tf JOIN df USING (term) JOIN len_ USING (doc_id), stat)"""


def _and_sql(terms: tuple[str, ...], unwanted: tuple[str, ...] = ()) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    without = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = '{t}')" for t in unwanted)
    return f"SELECT doc_id, sum(s) AS score FROM part WHERE term IN ({listed}){without} GROUP BY doc_id HAVING count(*) = {len(terms)}"


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("rank").cast("long").alias("rank"), "doc_key", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, hit AS ({_and_sql(TERMS)}) SELECT row_number() OVER (ORDER BY score DESC, source, lang || '/' || doc_id || '.md') AS rank, doc_id AS doc_key, round(score, 6) AS score FROM hit JOIN documents USING (doc_id) ORDER BY rank LIMIT 10")
def t06_bm25_search(spark, sf_dir):
    return _ranked(_search(spark, sf_dir, [(0, " ".join(TERMS))], limit=10))


@query(f"WITH {_BM25}, hit AS ({_and_sql(('with',), ('er',))}) SELECT row_number() OVER (ORDER BY score DESC, source, lang || '/' || doc_id || '.md') AS rank, doc_id AS doc_key, round(score, 6) AS score FROM hit JOIN documents USING (doc_id) ORDER BY rank LIMIT 20")
def t03_bm25_negation(spark, sf_dir):
    return _ranked(_search(spark, sf_dir, [(0, "with -er")], limit=20))


@query(f"""WITH {_BM25}, ph AS (SELECT a.doc_id, count(*) AS f FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id), n AS (SELECT count(*) AS n FROM ph),
hit AS (SELECT doc_id, (CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6::DOUBLE END) * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score FROM ph JOIN len_ USING (doc_id), n, stat)
SELECT row_number() OVER (ORDER BY score DESC, source, lang || '/' || doc_id || '.md') AS rank, doc_id AS doc_key, round(score, 6) AS score FROM hit JOIN documents USING (doc_id) ORDER BY rank LIMIT 20""")
def t04_bm25_phrase(spark, sf_dir):
    return _ranked(_search(spark, sf_dir, [(0, '"of the"')], limit=20))


@query(f"WITH {_BM25}, hit AS ({_and_sql(TERMS)}), r AS (SELECT row_number() OVER (ORDER BY score DESC, source, lang || '/' || doc_id || '.md') AS rank, doc_id AS doc_key, score FROM hit JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2', 'src3')) SELECT rank, doc_key, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.3")
def l05_bm25_filtered(spark, sf_dir):
    return _ranked(_search(spark, sf_dir, [(0, " ".join(TERMS))], limit=10, collections="src1,src2,src3", min_score=0.3))


@query(f"""WITH {_BM25}, q(query_id, term) AS (VALUES (1, 'with'), (1, 're'), (3, 'er'), (3, 'on'), (5, 'with')),
need AS (SELECT query_id, count(*) AS k FROM q GROUP BY query_id), hit AS (SELECT query_id, doc_id, sum(s) AS score FROM q JOIN need USING (query_id) JOIN part USING (term) GROUP BY query_id, doc_id HAVING count(*) = any_value(k)),
r AS (SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, lang || '/' || doc_id || '.md') AS rank, doc_id AS doc_key, score FROM hit JOIN documents USING (doc_id))
SELECT query_id, rank, doc_key, round(score, 6) AS score FROM r WHERE rank <= 10""")
def l06_bm25_batch(spark, sf_dir):
    hits = _search(spark, sf_dir, [(1, "with re"), (3, "er on"), (5, "with")], limit=10)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_key", F.round("score", 6).alias("score"))


@query()
def t07_snippets(spark, sf_dir):
    hits = _search(spark, sf_dir, SEARCHES, limit=5)
    return lexical.with_snippets(hits, SEARCHES, "simple").select("query_id", "rank", "doc_key", "snippet")


# --- vector search

_NEAR = """near AS (SELECT q.vec_id AS query_id, e.vec_id // 2 AS doc_key, e.vec_id AS chunk_key, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS l2, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cos
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"""


def _chunks(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"), F.expr("vec_id div 2").alias("doc_key"), "embedding")


def _query_vectors(spark, sf_dir):
    """The query set: every vector whose id is divisible by 20."""
    rows = _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select("vec_id", "embedding").collect()
    return [(r["vec_id"], list(r["embedding"])) for r in rows]


def _near_sql(metric: str) -> str:
    return f"""WITH {_NEAR}, best AS (SELECT query_id, doc_key, min({metric}) AS distance, arg_min(chunk_key, ({metric}, chunk_key)) AS chunk_key FROM near GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_key) AS rank FROM best)
SELECT query_id, rank, doc_key, chunk_key, round(distance, 6) + 0.0 AS distance, round(1 / (1 + distance), 6) AS score FROM r WHERE rank <= 10"""


def _near_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_key", "chunk_key", (F.round("distance", 6) + 0.0).alias("distance"), F.round("score", 6).alias("score"))


@query(_near_sql("l2"))
def v01_knn_l2(spark, sf_dir):
    return _near_columns(vector.nearest(_chunks(spark, sf_dir), _query_vectors(spark, sf_dir), 10))


@query(_near_sql("cos"))
def v01_knn_cosine(spark, sf_dir):
    return _near_columns(vector.nearest(_chunks(spark, sf_dir), _query_vectors(spark, sf_dir), 10, "cosine"))


@query("""SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS l2 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q""")
def j10_distance_expression(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    one = rows.filter("vec_id = 3").select(F.col("embedding").alias("wanted"))  # one row
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(vector.l2(F.col("embedding"), F.col("wanted")), 6).alias("l2"))


@query(f"""WITH {_NEAR}, best AS (SELECT query_id, doc_key, min(l2) AS distance FROM near JOIN documents d ON d.doc_id = doc_key WHERE d.source IN ('src0', 'src5') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_key) AS rank FROM best) SELECT query_id, rank, doc_key, round(1 / (1 + distance), 6) AS score FROM r WHERE rank <= 5 AND 1 / (1 + distance) >= 0.4""")
def v01_knn_filtered(spark, sf_dir):
    hits = vector.search(_chunks(spark, sf_dir), _query_vectors(spark, sf_dir), _corpus(spark, sf_dir), 5, "src0,src5", 0.4)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_key", F.round("score", 6).alias("score"))


@query("""SELECT item_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS seed FROM benchmark""")
def v06_hash_seed(spark, sf_dir):
    """The seed of whole texts, as HashEmbedder takes it."""
    return _table(spark, sf_dir, "benchmark").select("item_id", vector.fnv_seed(F.col("text")).alias("seed"))


@query()
def v04_embed_chunks(spark, sf_dir):
    chunks = chunking.chunk_documents(corpus_columns(_docs(spark, sf_dir))).withColumn("prompt", X.capped(X.document_prompt(F.lit("nomic"), F.lit(None).cast("string"), F.col("text"))))
    return vector.embed_texts(chunks.select("doc_key", "seq", "prompt"), vector.HashEmbedder(16)).select("doc_key", "seq", F.size("embedding").alias("dim"), F.round(vector.l2(F.col("embedding"), F.array_repeat(F.lit(0.0), 16)), 4).alias("norm"))


# --- fusion, expansion, rerank, evaluation

_ONE_NEAR = _NEAR.replace("vec_id % 20 = 0", "vec_id = 0")
_LISTS = f"""{_BM25}, {_ONE_NEAR}, c AS (SELECT doc_id, source AS collection, lang || '/' || doc_id || '.md' AS path FROM documents),
lex1 AS (SELECT * FROM (SELECT collection, path, score, row_number() OVER (ORDER BY score DESC, collection, path) AS rank FROM ({_and_sql(TERMS)}) JOIN c USING (doc_id)) WHERE rank <= 40),
lex2 AS (SELECT * FROM (SELECT collection, path, score, row_number() OVER (ORDER BY score DESC, collection, path) AS rank FROM ({_and_sql(('er',))}) JOIN c USING (doc_id)) WHERE rank <= 40),
vec AS (SELECT collection, path, rank, 1 / (1 + distance) AS score FROM (SELECT doc_key, min(l2) AS distance, row_number() OVER (ORDER BY min(l2), doc_key) AS rank FROM near JOIN c ON c.doc_id = doc_key WHERE query_id = 0 GROUP BY doc_key) JOIN c ON c.doc_id = doc_key WHERE rank <= 40)"""
_FUSED = f"""{_LISTS}, both_ AS (SELECT coalesce(a.collection, b.collection) AS collection, coalesce(a.path, b.path) AS path, a.rank AS bm25_rank, a.score AS bm25_score, b.rank AS vec_rank, b.score AS vec_score FROM lex1 a FULL JOIN vec b ON a.collection = b.collection AND a.path = b.path),
f1 AS (SELECT *, coalesce(1::DOUBLE / (60 + bm25_rank), 0) + coalesce(1::DOUBLE / (60 + vec_rank), 0) AS rrf_only, CASE WHEN least(coalesce(bm25_rank, 99), coalesce(vec_rank, 99)) = 1 THEN 0.05::DOUBLE WHEN least(coalesce(bm25_rank, 99), coalesce(vec_rank, 99)) <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END AS bonus FROM both_),
f2 AS (SELECT *, rrf_only + bonus AS fused_score, max(rrf_only + bonus) OVER () * 0.4 AS floor FROM f1),
fused AS (SELECT *, row_number() OVER (ORDER BY fused_score DESC, bm25_rank NULLS LAST, vec_rank NULLS LAST, collection, path) AS rank FROM f2 WHERE fused_score >= floor)"""


def _hit_lists(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    one = _search(spark, sf_dir, [(0, " ".join(TERMS))], limit=40)
    two = _search(spark, sf_dir, [(0, "er")], limit=40)
    near = vector.search(_chunks(spark, sf_dir), [q for q in _query_vectors(spark, sf_dir) if q[0] == 0], docs, 40)
    columns = ["query_id", "rank", "score", "collection", "path", "doc_id", "title"]
    return tuple(x.select(*columns) for x in (one, two, near))


@query(f"WITH {_LISTS}, m AS (SELECT collection, path, 2::DOUBLE / (60 + rank) AS s FROM lex1 UNION ALL SELECT collection, path, 1::DOUBLE / (60 + rank) FROM lex2) SELECT row_number() OVER (ORDER BY sum(s) DESC, collection, path) AS rank, collection, path, round(sum(s), 6) AS score FROM m GROUP BY collection, path")
def x01_merge_lists(spark, sf_dir):
    one, two, _ = _hit_lists(spark, sf_dir)
    return fusion.merge_lists([one, two]).select(F.col("rank").cast("long").alias("rank"), "collection", "path", F.round("score", 6).alias("score"))


@query(f"WITH {_FUSED} SELECT rank, collection, path, round(fused_score, 6) AS fused_score, bm25_rank, round(bm25_score, 6) AS bm25_score, vec_rank, round(vec_score, 6) AS vec_score, round(rrf_only, 6) AS rrf_only, bonus, round(floor, 6) AS floor FROM fused")
def x02_fuse_ranks(spark, sf_dir):
    one, _, near = _hit_lists(spark, sf_dir)
    got = fusion.fuse(one, near)
    ranks = {c: F.col(c).cast("long").alias(c) for c in ("rank", "bm25_rank", "vec_rank")}
    return got.select(ranks["rank"], "collection", "path", F.round("fused_score", 6).alias("fused_score"), ranks["bm25_rank"], F.round("bm25_score", 6).alias("bm25_score"), ranks["vec_rank"], F.round("vec_score", 6).alias("vec_score"), F.round("rrf_only", 6).alias("rrf_only"), "bonus", F.round("floor", 6).alias("floor"))


@query(f"WITH {_FUSED} SELECT rank, collection, path, round(fused_score, 6) AS score FROM fused WHERE rank <= 10")
def x03_hybrid_search(spark, sf_dir):
    """The flagship: lexical and vector search fused, cut to ten."""
    one, _, near = _hit_lists(spark, sf_dir)
    return fusion.fuse(one, near).filter("rank <= 10").select(F.col("rank").cast("long").alias("rank"), "collection", "path", F.round("fused_score", 6).alias("score"))


_CLASS = "CASE WHEN bm25_rank IS NOT NULL AND vec_rank IS NOT NULL THEN 'both' WHEN bm25_rank IS NOT NULL THEN 'lexical' ELSE 'vector' END"


@query(f"WITH {_FUSED} SELECT {_CLASS} AS side, count(*) AS n, round(max(fused_score), 6) AS best, round(min(fused_score / floor), 4) AS over_floor FROM fused GROUP BY ALL")
def x06_explain_summary(spark, sf_dir):
    one, _, near = _hit_lists(spark, sf_dir)
    got = fusion.fuse(one, near).withColumn("trace", F.from_json(fusion.explained(), "bm25_rank int, vec_rank int, floor double"))
    side = F.when(F.col("trace.bm25_rank").isNotNull() & F.col("trace.vec_rank").isNotNull(), "both").when(F.col("trace.bm25_rank").isNotNull(), "lexical").otherwise("vector")
    return got.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.round(F.max("fused_score"), 6).alias("best"), F.round(F.min(F.col("fused_score") / F.col("trace.floor")), 4).alias("over_floor"))


@query(f"WITH {_FUSED} SELECT rank, d.h || ',' || printf('%.4f', fused_score) || ',' || collection || '/' || path || ',' || collection AS value FROM fused JOIN (SELECT source, lang || '/' || doc_id || '.md' AS p, left(sha256(text), 6) AS h FROM documents) d ON d.source = collection AND d.p = path")
def k05_file_rows(spark, sf_dir):
    one, _, near = _hit_lists(spark, sf_dir)
    return sinks.file_rows(fusion.fuse(one, near).withColumn("score", F.col("fused_score"))).select(F.col("rank").cast("long").alias("rank"), "value")


_SHORT = r"regexp_replace(left(text, 30), '[\x09-\x0D]', ' ', 'g')"


@query(rf"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, text AS query, trim({_SHORT}) AS lex FROM conversations),
w AS (SELECT query_id, lex, regexp_split_to_array(regexp_replace(lower(lex), '[^a-z0-9 \t]', ' ', 'g'), '[ \t]+') AS c, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^a-z0-9 \t]', ' ', 'g'), '[ \t]+'), lambda x: length(x) > 1) AS q FROM a)
SELECT query_id, 'vec' AS kind, 'about ' || query_id AS content FROM a UNION ALL SELECT query_id, 'hyde', 'passage' FROM a UNION ALL SELECT query_id, 'lex', lex FROM w WHERE lex <> '' AND list_has_any(c, q)
UNION ALL SELECT query_id, 'lex', 'zzzz qqqq' FROM w WHERE list_has_any(['zzzz', 'qqqq'], q)""")
def x08_parse_variants(spark, sf_dir):
    """Answers made for every turn: a lexical variant of its own words, one of others, a vector and a document variant, and lines that do not count."""
    turns = _table(spark, sf_dir, "conversations").withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    short = F.regexp_replace(F.substring("text", 1, 30), r"[\x09-\x0D]", " ")
    answer = F.concat(F.lit("lex: "), short, F.lit("\nLEX: zzzz qqqq\n vec : about "), F.col("query_id").cast("string"), F.lit("\nhyde:passage\nother: no\nvec:"))
    rows = expansion.variants(turns.select("query_id", F.col("text").alias("query"), answer.alias("answer")))
    return rows.select("query_id", "kind", "content")


_LOGITS = "h AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rank, CAST(l_quantity AS DOUBLE) AS logit FROM lineitem)"
_NORMAL = f"{_LOGITS}, b AS (SELECT *, min(CASE WHEN rank <= 4 THEN logit END) OVER w AS lo, max(CASE WHEN rank <= 4 THEN logit END) OVER w AS hi, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY query_id)), s AS (SELECT *, CASE WHEN rank > 4 OR hi = lo THEN 0.5::DOUBLE ELSE (logit - lo) / (hi - lo) END AS rerank_score FROM b)"


def _logits(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    return rows.select(F.col("l_orderkey").alias("query_id"), rank.alias("rank"), F.col("l_quantity").cast("double").alias("logit"))


@query(f"WITH {_NORMAL} SELECT query_id, rank AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank, rerank_score FROM s")
def x11_rerank(spark, sf_dir):
    got = rerank.reranked(_logits(spark, sf_dir), top=4)
    return got.select("query_id", F.col("first_rank").cast("long").alias("first_rank"), F.col("rank").cast("long").alias("rank"), "rerank_score")


@query(f"""WITH {_NORMAL}, m AS (SELECT *, CASE WHEN rank <= 3 THEN 0.75::DOUBLE WHEN rank <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM s), x AS (SELECT *, w * (CASE WHEN n > 1 THEN 1 - (rank - 1)::DOUBLE / (n - 1) ELSE 1 END) + (1 - w) * rerank_score AS blended FROM m)
SELECT query_id, rank AS first_rank, blended AS blended_score FROM x""")
def x12_blend(spark, sf_dir):
    """Scores unrounded: both sides compute the same numbers, while rounding them meets ties."""
    got = rerank.blended(_logits(spark, sf_dir), top=4)
    return got.select("query_id", F.col("first_rank").cast("long").alias("first_rank"), "blended_score")


def _good(spark, sf_dir, query_ids):
    """query_id, item: documents of good quality, which count as relevant to each of these queries."""
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"))
    return good.withColumn("query_id", F.explode(F.array(*[F.lit(i).cast("long") for i in query_ids])))


@query(f"""WITH {_BM25}, q(query_id, term) AS (VALUES (1, 'with'), (3, 'er'), (5, 'zzzz')),
hit AS (SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source, lang || '/' || doc_id || '.md') AS rank FROM q JOIN part USING (term) JOIN documents USING (doc_id)),
top AS (SELECT query_id, rank, h.doc_id, coalesce(l.quality, 0) AS good FROM hit h LEFT JOIN labels l USING (doc_id) WHERE rank <= 10),
tot AS (SELECT count(*) AS n FROM labels WHERE quality = 1)
SELECT q.query_id::BIGINT AS query_id, round(coalesce(sum(good) FILTER (rank <= 5), 0) / 5, 6) AS p_at_5, round(coalesce(sum(good), 0) / any_value(tot.n), 6) AS r_at_10, round(coalesce(1 / min(rank) FILTER (good = 1), 0), 6) AS mrr FROM q LEFT JOIN top t USING (query_id), tot GROUP BY q.query_id""")
def x17_metrics(spark, sf_dir):
    """Documents of good quality count as relevant to every query."""
    hits = _search(spark, sf_dir, [(1, "with"), (3, "er"), (5, "zzzz")], limit=10)
    rows = evaluation.metrics_of_pairs(hits.select("query_id", "rank", F.col("doc_key").alias("item")), _good(spark, sf_dir, [1, 3, 5]))
    return rows.select("query_id", F.round("p_at_5", 6).alias("p_at_5"), F.round("r_at_10", 6).alias("r_at_10"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_BM25}, q(query_id, term) AS (VALUES (1, 'with'), (2, 're'), (3, 'er'), (4, 'on')),
hit AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source, lang || '/' || doc_id || '.md') AS rank FROM q JOIN part USING (term) JOIN documents USING (doc_id)),
top AS (SELECT query_id, rank, coalesce(l.quality, 0) AS good FROM hit LEFT JOIN labels l USING (doc_id) WHERE rank <= 10),
per AS (SELECT query_id, coalesce(sum(good) FILTER (rank <= 1), 0) / 1 AS p1, coalesce(sum(good) FILTER (rank <= 5), 0) / 5 AS p5, coalesce(sum(good), 0) / 10 AS p10, coalesce(1 / min(rank) FILTER (good = 1), 0) AS rr FROM top GROUP BY query_id)
SELECT round(avg(p1), 3) AS p_at_1, round(avg(p5), 3) AS p_at_5, round(avg(p10), 3) AS p_at_10, round(avg(rr), 3) AS mrr FROM per""")
def a10_macro_averages(spark, sf_dir):
    asked = [(1, "with"), (2, "re"), (3, "er"), (4, "on")]
    hits = _search(spark, sf_dir, asked, limit=10)
    rows = evaluation.metrics_of_pairs(hits.select("query_id", "rank", F.col("doc_key").alias("item")), _good(spark, sf_dir, [i for i, _ in asked]))
    return evaluation.summary(rows).select("p_at_1", "p_at_5", "p_at_10", "mrr")


@query()
def x16_benchmark_run(spark, sf_dir):
    """Every benchmark item as a query of all its words; the documents that hold it word for word are relevant."""
    items = [(r["item_id"], _words(r["text"] or "")) for r in _table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    docs = _corpus(spark, sf_dir)
    hits = _search(spark, sf_dir, [(i, " ".join(words)) for i, words in items], limit=10)
    qrels = evaluation.holders(docs.select("path", analyze.simple_terms(F.col("content")).alias("terms")), items)
    return evaluation.summary(evaluation.metrics(evaluation.identifiers(hits), qrels))


def _words(text: str) -> list[str]:
    return analyze.query_terms(text, "simple")


@query(f"WITH {_CORPUS} SELECT doc_key FROM corpus WHERE regexp_matches(path, '^(?:.*/)?[^/]*[.](?:txt|md|go)$')")
def s02_default_glob(spark, sf_dir):
    return _corpus(spark, sf_dir).filter(globs.matches(F.col("path"), globs.DEFAULT_GLOB)).select("doc_key")

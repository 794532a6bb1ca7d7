"""Lexical search: positional inverted index, boolean and phrase matching, BM25.

The index is three DataFrames. Many queries are answered by one plan: postings
are joined with the queries' terms, scored, and cut to the best rows of each
query. Statistics are those of the whole corpus, whatever the filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions import query_syntax
from textquarry.functions.analyze import ANALYZERS, porter_tokens, query_terms

#: The usual constants of BM25 and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEFAULT_LIMIT = 5
SNIPPET_TOKENS = 15
MARK, UNMARK = "\x1b[1m", "\x1b[0m"
TERM_BUCKETS = 64
#: Tokens whose postings go into one file.
FILE_TOKENS = 8_000_000
#: Queries are sent to all tasks only up to this many term rows.
BROADCAST_TERMS = 100_000

CLAUSES = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("clause", T.IntegerType()), T.StructField("step", T.IntegerType()),
    T.StructField("steps", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("negated", T.BooleanType()),
])

#: The written tables, by documents of long keys; a table without rows has no file that tells its columns.
TABLES = {
    "postings": "term string, doc_key long, field int, tf long, positions array<int>, term_bucket int",
    "lengths": "doc_key long, length long",
    "corpus": "n_docs long, total_length long",
}


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame  # term, doc_key, field, tf, positions, term_bucket
    lengths: DataFrame  # doc_key, length
    corpus: DataFrame  # n_docs, avg_length
    analyzer: str

    def write(self, path: str) -> None:
        """Postings are bucketed and sorted by term, so a query reads few row groups.

        A bucket is cut into as many files as its share of the tokens asks for,
        by a salt of doc_key: a word of every document is not one task's work.
        """
        self.lengths.write.parquet(f"{path}/lengths")
        written = self.lengths.sparkSession.read.parquet(f"{path}/lengths")
        totals = written.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))
        totals.write.parquet(f"{path}/corpus")  # one row
        tokens = totals.first()["total_length"]
        salt = F.pmod(F.xxhash64("doc_key", F.lit("salt")), F.lit(-(-tokens // (TERM_BUCKETS * FILE_TOKENS)) or 1))
        self.postings.repartition("term_bucket", salt).sortWithinPartitions("term_bucket", "term", "doc_key").write.partitionBy("term_bucket").parquet(f"{path}/postings")

    @classmethod
    def read(cls, spark: SparkSession, path: str, analyzer: str) -> LexicalIndex:
        return cls.joined([[spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "corpus")]], analyzer)

    @classmethod
    def joined(cls, parts: list[list[DataFrame]], analyzer: str) -> LexicalIndex:
        """One index of parts that hold different documents: postings, lengths, and totals, which may count documents off."""
        postings, lengths, totals = (reduce(DataFrame.unionByName, tables) for tables in zip(*parts, strict=True))
        corpus = totals.agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_length") / F.sum("n_docs")).alias("avg_length"))
        return cls(postings, lengths, corpus, analyzer)

    def of_terms(self, terms: list[str]) -> LexicalIndex:
        """The same with the postings of these terms alone: only their buckets are read."""
        buckets = [term_bucket(F.lit(t)) for t in terms]  # constants to the planner
        here = self.postings.filter(F.col("term_bucket").isin(*buckets) & F.col("term").isin(terms))
        return LexicalIndex(here, self.lengths, self.corpus, self.analyzer)


def term_bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def build(docs: DataFrame, key: str = "doc_key", fields: tuple[str, ...] = ("title", "content"), analyzer: str = "simple", only_terms: list[str] | None = None) -> LexicalIndex:
    """Indexes the text columns `fields` of docs; with only_terms, postings of those terms alone.

    For queries over texts that no index stands for, only_terms drops all other
    tokens before anything is shuffled. Lengths and counts stay those of whole texts.
    """
    analyze = ANALYZERS[analyzer]
    per_field = F.array(*[F.struct(F.lit(i).alias("field"), analyze(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for i, f in enumerate(fields)])
    analyzed = docs.select(F.col(key).alias("doc_key"), F.explode(per_field).alias("f")).select("doc_key", "f.field", "f.terms")
    tokens = analyzed.select("doc_key", "field", F.posexplode("terms").alias("pos", "term"))
    if only_terms is not None:
        tokens = tokens.filter(F.col("term").isin(only_terms))
    postings = tokens.groupBy("term", "doc_key", "field").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    postings = postings.withColumn("term_bucket", term_bucket(F.col("term")))
    lengths = analyzed.groupBy("doc_key").agg(F.sum(F.size("terms")).cast("long").alias("length"))
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    return LexicalIndex(postings, lengths, corpus, analyzer)


def clause_rows(query_id: int, query: str, analyzer: str) -> list[tuple]:
    """Rows of CLAUSES; a plain word of several terms is a phrase, one without terms asks for nothing."""
    wanted, unwanted = query_syntax.effective(query)
    rows, n = [], 0
    for negated, clauses in ((False, wanted), (True, unwanted)):
        for c in clauses:
            terms = query_terms(c.text, analyzer)
            rows += [(query_id, n, i, len(terms), t, negated) for i, t in enumerate(terms)]
            n += bool(terms)
    return rows if any(not r[-1] for r in rows) else []


def terms_of(queries: list[tuple[int, str]], analyzer: str) -> list[str]:
    """All terms that the queries ask for."""
    return sorted({r[4] for i, q in queries for r in clause_rows(i, q, analyzer)})


def parsed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    frame = spark.createDataFrame(rows, CLAUSES)
    return F.broadcast(frame) if len(rows) <= BROADCAST_TERMS else frame


def clause_matches(index: LexicalIndex, clauses: DataFrame, phrases: bool = True) -> DataFrame:
    """query_id, clause, negated, doc_key and f, how often the clause occurs in the document."""
    hits = index.postings.join(clauses, "term")
    single = hits.filter("steps = 1").groupBy("query_id", "clause", "negated", "doc_key").agg(F.sum("tf").alias("f"))
    if not phrases:
        return single
    # a phrase occurs where each of its terms stands at its own distance from one start
    places = hits.filter("steps > 1").select("query_id", "clause", "negated", "steps", "doc_key", "field", "step", F.explode("positions").alias("pos"))
    starts = places.groupBy("query_id", "clause", "negated", "steps", "doc_key", "field", (F.col("pos") - F.col("step")).alias("start")).agg(F.count("*").alias("met"))
    whole = starts.filter("met = steps").groupBy("query_id", "clause", "negated", "doc_key").agg(F.count("*").alias("f"))
    return single.unionByName(whole)


def scores(index: LexicalIndex, clauses: DataFrame, phrases: bool = True, negations: bool = True) -> DataFrame:
    """query_id, doc_key, score of every document that has all wanted clauses and no unwanted one.

    Without phrases or negations among the clauses, their part of the plan is left out.
    """
    matches = clause_matches(index, clauses, phrases)
    wanted, unwanted = matches.filter("not negated"), matches.filter("negated")
    needed = clauses.filter("not negated").groupBy("query_id").agg(F.count_distinct("clause").alias("needed"))
    spread = wanted.groupBy("query_id", "clause").agg(F.count("*").alias("n"))  # one row per clause
    corpus = F.broadcast(index.corpus)  # one row
    n, n_docs = F.col("n"), F.col("n_docs")
    idf = F.log((n_docs - n + 0.5) / (n + 0.5))
    weight = spread.crossJoin(corpus).select("query_id", "clause", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"), "avg_length")
    scored = wanted.join(weight, ["query_id", "clause"]).join(index.lengths, "doc_key")
    f = F.col("f")
    part = F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    total = scored.groupBy("query_id", "doc_key").agg(F.sum(part).alias("score"), F.count("*").alias("met"))
    full = total.join(needed, "query_id").filter("met = needed").select("query_id", "doc_key", "score")
    return full.join(unwanted.select("query_id", "doc_key"), ["query_id", "doc_key"], "left_anti") if negations else full


def top_rows(hits: DataFrame, limit: int | None, order: list, by: str = "query_id") -> DataFrame:
    """Adds rank (from 1) per query and keeps the first `limit` rows of each."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def search(index: LexicalIndex, queries: list[tuple[int, str]], docs: DataFrame, limit: int | None = None, collections: str | None = None, min_score: float = 0.0, every: bool = False) -> DataFrame:
    """query_id, rank, score and the columns of docs (doc_key, collection, path, ...) for each query.

    The collection filter does not touch the statistics; the limit comes before the minimum score.
    """
    rows = [r for i, q in queries for r in clause_rows(i, q, index.analyzer)]
    clauses = parsed(docs.sparkSession, rows)
    found = scores(index, clauses, any(r[3] > 1 for r in rows), any(r[-1] for r in rows))
    places = docs.select("doc_key", "collection", "path")
    names = query_syntax.split_collections(collections)
    found = found.join(places.filter(F.col("collection").isin(names)) if names else places, "doc_key")
    size = None if every else (limit or DEFAULT_LIMIT)
    top = top_rows(found, size, [F.desc("score"), F.col("collection"), F.col("path")]).filter(F.col("score") >= min_score)
    shown = docs.drop("collection", "path")  # texts join the best rows alone
    return top.join(shown, "doc_key") if len(shown.columns) > 1 else top


def snippet(text: str | None, phrases: list[list[str]], analyzer: str = "porter", width: int = SNIPPET_TOKENS) -> str:
    """The window of `width` tokens with the most distinct phrases, matches marked."""
    text = text or ""
    if analyzer == "porter":
        tokens = porter_tokens(text)
    else:
        import re

        tokens = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    terms = [t for t, _, _ in tokens]
    spans = sorted((i, i + len(p), k) for k, p in enumerate(phrases) if p for i in range(len(terms) - len(p) + 1) if terms[i : i + len(p)] == p)
    best, first = -1, 0
    for start in sorted({0, *[max(0, min(s, len(terms) - width)) for s, _, _ in spans], *[s for s, _, _ in spans]}):
        inside = [k for a, b, k in spans if a >= start and b <= start + width]
        worth = len(set(inside)) * 1000 + len(inside)
        if worth > best:
            best, first = worth, start
    last = min(first + width, len(terms))
    if not terms:
        return text
    begin = 0 if first == 0 else tokens[first][1]
    end = len(text) if last == len(terms) else tokens[last - 1][2]
    out, at = [], begin
    covered = first
    for a, b, _ in spans:
        if a >= covered and b <= last:
            out += [text[at : tokens[a][1]], MARK, text[tokens[a][1] : tokens[b - 1][2]], UNMARK]
            at, covered = tokens[b - 1][2], b
    return ("..." if first else "") + "".join(out) + text[at:end] + ("..." if last < len(terms) else "")


def with_snippets(hits: DataFrame, queries: list[tuple[int, str]], analyzer: str, column: str = "content") -> DataFrame:
    """Adds a snippet to the hits alone, after the cut to the best rows."""
    phrases = {}
    for query_id, query in queries:
        grouped: dict[int, list[str]] = {}
        for _, clause, _, _, term, negated in clause_rows(query_id, query, analyzer):
            if not negated:
                grouped.setdefault(clause, []).append(term)
        phrases[query_id] = list(grouped.values())

    @F.pandas_udf(T.StringType())
    def run(ids, texts):
        return texts.combine(ids, lambda t, q: snippet(t, phrases.get(q, []), analyzer))

    return hits.withColumn("snippet", run(F.col("query_id"), F.col(column)))

"""Result formats: JSON, CSV, XML, Markdown, file lists and plain text."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import plain_text
from textquarry.operators.fusion import explained

#: Rows shown unless told otherwise, for people and for programs.
HUMAN_LIMIT, MACHINE_LIMIT = 5, 20
#: In order of priority when several are asked for.
FORMATS = ("json", "csv", "xml", "md", "files", "text")


def chosen_format(asked: set[str]) -> str:
    return next((f for f in FORMATS if f in asked), "text")


def default_limit(fmt: str) -> int:
    return MACHINE_LIMIT if fmt in ("json", "csv", "xml", "files") else HUMAN_LIMIT


def _clean(hits: DataFrame) -> DataFrame:
    return hits.withColumn("snippet", plain_text(F.coalesce("snippet", F.lit(""))))


def json_rows(hits: DataFrame, explain: bool = False) -> DataFrame:
    """One JSON object per hit, in a column `value`; explain adds the trace of a fused score."""
    fields: list[str | Column] = ["doc_id", "title", "path", "collection", "score", "snippet"]
    rows = _clean(hits)
    if explain:
        rows = rows.withColumn("explain", F.from_json(explained(), "bm25_rank int, bm25_score double, vec_rank int, vec_score double, rrf_only double, bonus double, floor double"))
        fields.append("explain")
    return rows.select("rank", F.to_json(F.struct(*fields)).alias("value"))


def csv_rows(hits: DataFrame) -> DataFrame:
    return _clean(hits).select("rank", "doc_id", "title", "collection", "path", F.format_string("%.4f", F.col("score")).alias("score"), "snippet")


def file_rows(hits: DataFrame) -> DataFrame:
    """`doc_id,score,collection/path,collection` in a column `value`."""
    return hits.select("rank", F.concat_ws(",", "doc_id", F.format_string("%.4f", F.col("score")), F.concat_ws("/", "collection", "path"), "collection").alias("value"))


def markdown_rows(hits: DataFrame) -> DataFrame:
    return _clean(hits).select("rank", F.format_string("## %s\n\n- **Path:** %s/%s\n- **Doc:** #%s\n- **Score:** %.2f\n\n%s\n", F.coalesce("title", F.lit("")), F.col("collection"), F.col("path"), F.col("doc_id"), F.col("score"), F.col("snippet")).alias("value"))


def _lines(rows: DataFrame) -> list:
    """The hits of one query, at most a few dozen, on the driver for display."""
    return rows.orderBy("rank").collect()


def render(hits: DataFrame, fmt: str = "text") -> str:
    """The hits of one query as text in one of FORMATS."""
    if fmt == "json":
        return "[\n" + ",\n".join("  " + r["value"] for r in _lines(json_rows(hits))) + "\n]"
    if fmt == "csv":
        import csv
        import io

        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["doc_id", "title", "collection", "path", "score", "snippet"])
        for r in _lines(csv_rows(hits)):
            writer.writerow(r[1:])
        return out.getvalue()
    if fmt == "xml":
        one: Callable = lambda r: "  <result>" + "".join(f"<{k}>{escape(str(r[k] or ''))}</{k}>" for k in ("doc_id", "title", "path", "collection", "score", "snippet")) + "</result>"
        return "<results>\n" + "\n".join(map(one, _lines(_clean(hits)))) + "\n</results>"
    if fmt in ("md", "files"):
        return "\n".join(r["value"] for r in _lines(markdown_rows(hits) if fmt == "md" else file_rows(hits)))
    rows = _lines(hits)
    return "\n\n".join(f"{r['rank']}. {r['title']}  [{r['score']:.4f}]\n   {r['collection']}/{r['path']}  #{r['doc_id']}\n   {r['snippet']}" for r in rows) or "No results."


def write(hits: DataFrame, path: str, fmt: str) -> None:
    """Any number of hits as files, written by the workers."""
    if fmt == "json":
        _clean(hits).select("doc_id", "title", "path", "collection", "score", "snippet").write.json(path)
    elif fmt == "csv":
        csv_rows(hits).drop("rank").write.option("header", True).csv(path)
    elif fmt == "xml":
        _clean(hits).select("doc_id", "title", "path", "collection", "score", "snippet").write.format("xml").options(rootTag="results", rowTag="result").save(path)
    else:
        (markdown_rows(hits) if fmt == "md" else file_rows(hits)).select("value").write.text(path)


def documents_text(docs: DataFrame) -> str:
    """Several documents, asked for by name, between --- lines."""
    return "\n---\n".join(r["content"] or "" for r in docs.select("content").collect())


def documents_json(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct("doc_id", "collection", "path", "title", "content")).alias("value"))

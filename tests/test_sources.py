"""Folders with files that cannot be read or are no text, and every format for people."""

import csv
import io
import json
import os
import xml.etree.ElementTree as ET

from textquarry.sources import sinks
from textquarry.sources.readers import read_folder


def test_files_that_are_no_text_or_gone(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.md").write_text("# Good")
    (tmp_path / "bad.md").write_bytes(b"caf\xe9 \xff ok")
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / "sub" / "deep.txt").write_text("deep")
    (tmp_path / "skip.bin").write_bytes(b"\x00")
    os.symlink(tmp_path / "nowhere.md", tmp_path / "gone.md")
    rows = read_folder(spark, "c", str(tmp_path))
    os.unlink(tmp_path / "good.md")  # listed, but gone when it is read
    (tmp_path / "good.md").write_text("# Good again")
    got = {r["path"]: r["content"] for r in rows.collect()}
    assert set(got) - {"good.md"} == {"bad.md", "sub/deep.txt"}  # Spark lists no empty files
    assert got["bad.md"] == "caf� � ok"


def _hits(spark):
    rows = [(0, 1, "ab12cd", "T <&> \"q\"", "a/b.md", "c", 0.5, "\x1b[1mx\x1b[0m, \"y\"\nz"), (0, 2, "ffffff", None, "e.md", "c", 0.25, None)]
    return spark.createDataFrame(rows, "query_id long, rank int, doc_id string, title string, path string, collection string, score double, snippet string")


def test_formats(spark):
    hits = _hits(spark)
    shown = json.loads(sinks.render(hits, "json"))
    assert [h["doc_id"] for h in shown] == ["ab12cd", "ffffff"] and shown[0]["snippet"] == 'x, "y"\nz' and list(shown[0]) == ["doc_id", "title", "path", "collection", "score", "snippet"]
    table = list(csv.reader(io.StringIO(sinks.render(hits, "csv"))))
    assert table[0] == ["doc_id", "title", "collection", "path", "score", "snippet"] and table[1] == ["ab12cd", 'T <&> "q"', "c", "a/b.md", "0.5000", 'x, "y"\nz'] and table[2][4] == "0.2500"
    tree = ET.fromstring(sinks.render(hits, "xml"))
    assert tree.tag == "results" and [r.findtext("title") for r in tree] == ['T <&> "q"', ""] and tree[0].findtext("snippet") == 'x, "y"\nz'
    assert sinks.render(hits, "files") == "ab12cd,0.5000,c/a/b.md,c\nffffff,0.2500,c/e.md,c"
    assert "## T <&>" in sinks.render(hits, "md") and "- **Score:** 0.50" in sinks.render(hits, "md")
    assert sinks.render(hits, "text").startswith("1. T <&>") and sinks.render(hits.limit(0), "text") == "No results."
    assert sinks.chosen_format({"md", "csv", "text"}) == "csv" and [sinks.default_limit(f) for f in ("json", "md")] == [20, 5]


def test_written_formats(spark, tmp_path):
    hits = _hits(spark)
    for fmt in ("json", "csv", "xml", "md", "files"):
        sinks.write(hits, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.format("xml").option("rowTag", "result").load(str(tmp_path / "xml")).count() == 2


def test_several_documents(spark):
    docs = spark.createDataFrame([("a", "c", "p", "t", "one"), ("b", "c", "q", "u", None)], "doc_id string, collection string, path string, title string, content string")
    assert sinks.documents_text(docs) == "one\n---\n"
    assert [json.loads(r["value"])["path"] for r in sinks.documents_json(docs).collect()] == ["p", "q"]

"""Whole tables: queries without row filters against plain loops that follow the reference."""

import pytest

from tests.oracle import DATA
from textquarry.plans import catalog_queries as q

TEXTS = ["One. Two.", "Line\nbreak. More", "a # b. c", "# Head line \nrest", "---\nx: 1\n---\nBody. End", "---\nopen", "+++\na = 1\n+++\n\n# Plus\n.", " lead. x", "\n\n---\nk\n---\r\n\r\nz", "\r\nstart", "x --- y +++ z.", "", "  # Deep \t\nq", ".dot first", "---\n---\nno body", "## two\n# one"]


def _stripped(s):
    trimmed = s.lstrip(" \t\r\n")
    for mark in ("---", "+++"):
        if trimmed.startswith((mark + "\n", mark + "\r\n")):
            rest = trimmed[3:].lstrip("\r\n")
            end = rest.find("\n" + mark)
            return s if end < 0 else rest[end + 4 :].lstrip("\r\n")
    return s


def _title(s, stem):
    for line in _stripped(s).split("\n"):
        if line.strip().startswith("# "):
            return line.strip()[2:].strip()
    return stem


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_titles_of_every_document(spark, folder):
    at, rows = folder
    got = {r["doc_id"]: r["title"] for r in q.f03_titles(spark, at).collect()}
    assert got == {i: _title(f"---\ntags: x\n---\n\n# {t.split('.')[0]}\n{t}" if i % 3 == 0 else t, str(i)) for i, t in rows}


def test_front_matter_of_every_document(spark, folder):
    at, rows = folder
    before = ("---\na: 1\n---\n", "+++\na = 1\n+++\n\n", "---\nunclosed", "")
    got = {r["doc_id"]: r["n_chars"] for r in q.f05_frontmatter(spark, at).collect()}
    assert got == {i: len(_stripped(before[i % 4] + t)) for i, t in rows}


@pytest.mark.parametrize("name", ["x11_rerank", "x12_blend"])
def test_every_row_is_reranked(spark, name):
    assert q.queries()[name](spark, f"{DATA}/sf0.001").count() == spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").count()

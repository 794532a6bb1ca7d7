import sqlite3

import pytest
from pyspark.sql import functions as F

from textquarry.functions import analyze, chunking, globs, query_syntax
from textquarry.functions import text as X

CASES = [
    ("search", "search"), ("is deep", "is deep"), ("the deep sea", "the deep sea"),
    ("Why did the crew leave their ship?", "crew leave ship"), ("can't stop the engine cooling loop", "stop engine cooling loop"),
    ("cool*", "cool"), ("cool OR warm", "cool or warm"), ("NOT", "not"), (" \t ", ""), ("ice-cold water tank level", "ice cold water tank level"),
    ('"deep sea"', '"deep sea"'), ('"deep sea" dive', '"deep sea" dive'), ('"open end', '"open end"'), ('"" dive', "dive"), ('"deep-sea*:"', '"deep sea"'),
    ("dive -tank", "dive NOT tank"), ('dive -"deep sea"', 'dive NOT "deep sea"'), ("dive -a -b", "dive NOT a NOT b"), ("dive - - tank", "dive tank"),
    ("dive --tank", "dive tank"), ("-dive -tank", ""), ("what is the deep dive -the", "deep dive NOT the"), ("çok derin için bir dalış", "derin dalış"),
    ("foo_bar", "foo_bar"), ("? : * (", ""),
]


@pytest.mark.parametrize(("typed", "canonical"), CASES)
def test_query_syntax(typed, canonical):
    assert query_syntax.normalised(typed) == canonical


def test_specs():
    assert query_syntax.parse_document_spec("a/b.md:42") == ("a/b.md", 42)
    assert query_syntax.parse_document_spec("a/b:c.md") == ("a/b:c.md", 0)
    assert query_syntax.parse_context_spec("/") == (None, "/")
    assert query_syntax.parse_context_spec("notes") == ("notes", "/")
    assert query_syntax.parse_context_spec("notes/a/b") == ("notes", "a/b")
    assert query_syntax.split_collections(" a, ,b ") == ["a", "b"]


@pytest.mark.parametrize(("pattern", "path", "fits"), [
    ("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("*.md", "x/a.md", False), ("a?.{md,txt}", "ab.txt", True),
    ("[!a]*.md", "ab.md", False), ("x/**", "x/y/z", True), (globs.DEFAULT_GLOB, "Dockerfile", False), (globs.DEFAULT_GLOB, "d/x.Dockerfile", True),
])
def test_globs(spark, pattern, path, fits):
    assert spark.range(1).select(globs.matches(F.lit(path), pattern)).first()[0] is fits


@pytest.mark.parametrize(("content", "path", "title"), [
    ("# Top\nx", "a.md", "Top"), ("---\nt: 1\n---\n# In body\n", "a.md", "In body"), ("no heading", "x/notes.v2.md", "notes.v2"),
    ("  # Indented  \n", "a.md", "Indented"), ("# \n# Second", "a.md", "Second"), ("package a\n\nfunc low() {}\n\ntype Box struct{}", "a.go", "package a — Box"),
    ("package only", "a.go", "package only"), ("    async def run():", "a.py", "run"), ("class A {}\nexport const b = 1", "a.ts", "b"),
    ("public abstract class Big {", "A.java", "Big"), ("pub trait Walk {}", "a.rs", "Walk"), ("nothing", "a.rs", "a"),
])
def test_titles(spark, content, path, title):
    assert spark.range(1).select(X.title(F.lit(content), F.lit(path))).first()[0] == title


def test_token_estimates():
    assert [chunking.estimate(x) for x in ("", "hello", "two words", "a b c d e f g h", " \n ")] == [0, 1, 3, 10, 0]


@pytest.mark.parametrize(("base", "distance", "window", "value"), [(100, 0, 200, 100), (100, 200, 200, 30), (100, 100, 200, 82.5), (100, 900, 200, 30), (50, -5, 200, 50), (80, 10, 0, 80)])
def test_cut_values(base, distance, window, value):
    assert chunking.value_at(base, distance, window) == pytest.approx(value)


def _covers(content, pieces):
    raw = content.encode()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)
    for (_, end, _), (start, _, _) in zip(pieces, pieces[1:], strict=False):
        assert start <= end
    assert all(raw[a:b].decode() == t for a, b, t in pieces)


def test_long_text_is_cut_with_overlap():
    content = "".join(f"wörd{i}" + ("\n" if i % 12 == 11 else " ") for i in range(3000))
    pieces = chunking.split_text(content)
    _covers(content, pieces)
    assert len(pieces) > 3
    for (a, b, _), (c, _, _) in zip(pieces, pieces[1:], strict=False):
        assert 0.08 <= (b - c) / (b - a) <= 0.25


def test_fences_stay_whole():
    content = "intro words here\n" * 200 + "```\n" + "code line of words\n" * 400 + "```\n" + "tail words\n" * 300
    pieces = chunking.split_text(content)
    _covers(content, pieces)
    assert all(t.count("```") in (0, 2) for _, _, t in pieces)


def test_headings_win_and_one_line_is_one_chunk():
    content = "plain words in a line\n" * 165 + "# Heading\n" + "more words in a line\n" * 200
    assert any(t.startswith("# Heading") or "\n# Heading" in t for _, _, t in chunking.split_text(content)[1:])
    assert len(chunking.split_text("word " * 1500)) == 1
    assert chunking.split_text("") == []


@pytest.mark.parametrize(("lang", "path", "unit"), [
    ("go", "a.go", "func F{i}() {{\n\tcall(\"}}\") // {{\n\treturn\n}}\n\n"), ("python", "a.py", "@deco\ndef f{i}():\n    return 1\n\n"),
    ("rust", "a.rs", "pub fn f{i}() {{\n    let a = '}}';\n}}\n\n"), ("typescript", "a.ts", "export function f{i}() {{\n  return `}}`;\n}}\n\n"), ("java", "A.java", "public class C{i} {{\n  int x = 1;\n}}\n\n"),
])
def test_code_is_cut_between_constructs(lang, path, unit):
    content = "".join(unit.format(i=i) for i in range(300))
    pieces = chunking.split_file(content, path)
    assert len(pieces) > 1
    assert "".join(t for _, _, t in pieces) == content
    assert all(t.lstrip().startswith(unit.split("{i}")[0].split("\n")[0][:4]) for _, _, t in pieces)
    assert chunking.split_file(content, path, "regex") == chunking.split_text(content)
    assert chunking.split_file("def broken(:\n" * 3, "a.py") == chunking.split_text("def broken(:\n" * 3)


def test_porter_analyzer_equals_fts5():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    texts = [
        "relational conditional rationalize generalizations oscillators happiness sized filing failing agreed hopping controlling digitizer radically",
        "vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti triplicate formative electriciti",
        "Café naïve été straße foo_bar x1y2 ½ ² flies dies sky say enjoy by ties caress cats feed bled plastered motoring sing adoption revival",
        "", "!!! ???", "A1b2 C_d-e f'g",
    ]
    for i, text in enumerate(texts):
        con.execute("insert into t(rowid, x) values (?, ?)", (i, text))
        wanted = [r[0] for r in con.execute("select term from v where doc = ? order by offset", (i,))]
        assert [term for term, _, _ in analyze.porter_tokens(text)] == wanted

"""Text expressions: hashes, titles, token estimates, line classes, prompts and display cuts.

Everything here is a Column built from Spark's own functions, so it stays inside
code generation and is pushed through projections.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind and by language.
KIND_EXTENSIONS = {
    "markdown": ("md", "txt", "rst"),
    "code": ("go", "ts", "tsx", "js", "jsx", "py", "java", "rs", "rb", "php", "c", "cpp", "h", "hpp", "cs", "swift", "kt", "scala"),
    "config": ("yaml", "yml", "toml", "json", "xml", "html", "css", "scss", "proto", "graphql", "sql"),
}
LANGUAGE_EXTENSIONS = {"go": ("go",), "python": ("py",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx"), "java": ("java",), "rust": ("rs",)}
#: Words to tokens, and the scores of places where a text may be cut.
TOKENS_PER_WORD = 1.3
HEADING_SCORES = (100, 90, 80, 70, 60, 50)
RULE_SCORE, FENCE_SCORE, BLANK_SCORE, LIST_SCORE, LINE_SCORE = 60, 80, 20, 5, 1
SNIPPET_CHARS = 240
RERANK_CHARS = 800
#: Unicode white space.
UNICODE_SPACE = r"[\t-\r\x20\x85\xA0  -     　]"


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(content.cast("binary"), 256)


def short_id(digest: Column, size: int = 6) -> Column:
    return F.substring(digest, 1, size)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def file_kind(path: Column) -> Column:
    ext, out = extension(path), F.lit("text")
    for kind, known in KIND_EXTENSIONS.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit("")
    for name, known in LANGUAGE_EXTENSIONS.items():
        out = F.when(ext.isin(*known), name).otherwise(out)
    return out


def strip_frontmatter(content: Column) -> Column:
    """Without a leading block between --- or +++ lines; unchanged if it is not closed."""
    return F.regexp_replace(content, r"\A[ \t\r\n]*(---|\+\+\+)\r?\n[\r\n]*+(?s:.*?)\n\1[\r\n]*", "")


def _first(content: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(content, "(?m)" + pattern, group), F.lit(""))


#: The words that declare a public symbol, by language; what may stand before them; how names are spelled.
DECLARES = {
    "python": (("", "async"), ("class", "def")),
    "exported": (("export",), ("function", "class", "interface", "type", "const", "let", "var")),
    "script": (("", "async"), ("function", "class", "interface")),
    "java": (("public",), ("class", "interface", "enum")),
    "rust": (("pub",), ("fn", "struct", "enum", "trait", "mod")),
}
BETWEEN = {"exported": ("default", "async"), "java": ("final", "abstract")}
NAME, SCRIPT_NAME = "[A-Za-z_][A-Za-z0-9_]*", "[A-Za-z_$][A-Za-z0-9_$]*"


def _declared(content: Column, kind: str, name: str = NAME) -> Column:
    """The first name on a line that begins with a declaration of this kind, null if none."""
    lead, words = DECLARES[kind]
    before = "".join(f"(?:{w}\\s+)" + ("?" if "" in lead else "") for w in lead if w)
    options = BETWEEN.get(kind, ())
    # `default` and `async` may both stand there, of `final` and `abstract` one
    between = "".join(f"(?:{w}\\s+)?" for w in options) if kind == "exported" else f"(?:(?:{'|'.join(options)})\\s+)?" if options else ""
    return _first(content, rf"^\s*{before}{between}(?:{'|'.join(words)})\s+({name})")


def _go_title(content: Column) -> Column:
    """Package and first exported function or type, as far as they are there."""
    package = _first(content, rf"^\s*package\s+({NAME})")
    receiver, exported = r"(?:\([^)\n]*\)\s+)?", "[A-Z][A-Za-z0-9_]*"
    symbol = _first(content, rf"^\s*(?:func\s+{receiver}(?={exported}\s*\()|type\s+)({exported})")
    return F.nullif(F.concat_ws(" — ", F.concat(F.lit("package "), package), symbol), F.lit(""))


def code_title(content: Column, path: Column) -> Column:
    """The first public symbol of a source file, '' if none."""
    kind = language(path)
    found = {
        "go": _go_title(content), "python": _declared(content, "python"), "java": _declared(content, "java"), "rust": _declared(content, "rust"),
        "javascript": F.coalesce(_declared(content, "exported", SCRIPT_NAME), _declared(content, "script", SCRIPT_NAME)),
    }
    found["typescript"] = found["javascript"]
    out = F.lit("")
    for name, symbol in found.items():
        out = F.when(kind == name, F.coalesce(symbol, F.lit(""))).otherwise(out)
    return out


def title(content: Column, path: Column) -> Column:
    """Symbol of a source file, else the first top heading of the body, else the file's stem."""
    heading = F.nullif(F.regexp_extract(strip_frontmatter(content), r"(?md)^[ \t]*# [ \t]*(\S[^\n]*?)[ \t\r]*$", 1), F.lit(""))
    return F.coalesce(F.nullif(code_title(content, path), F.lit("")), heading, stem(path))


def words(content: Column) -> Column:
    return F.filter(F.split(content, UNICODE_SPACE + "+"), lambda w: w != "")


def token_estimate(content: Column) -> Column:
    return F.floor(F.size(words(content)) * F.lit(TOKENS_PER_WORD) + F.lit(0.5)).cast("long")


def break_score(base: Column, distance: Column, window: Column) -> Column:
    """base, reduced with the square of the distance relative to the window, by 0.7 at most."""
    share = F.least(F.greatest(distance.cast("double") / window, F.lit(0.0)), F.lit(1.0))
    return F.when(window <= 0, base.cast("double")).otherwise(base * (F.lit(1.0) - share * share * F.lit(0.7)))


def line_score(line: Column, number: Column) -> Column:
    """How good a cut before this line is; `number` counts lines from 0."""
    trimmed = F.regexp_replace(line, rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")
    depth = F.length(F.regexp_extract(trimmed, r"^(#{1,6}) ", 1))
    out = F.when(depth > 0, F.element_at(F.array(*[F.lit(s) for s in HEADING_SCORES]), F.greatest(depth, F.lit(1))))
    return (
        out.when(trimmed.isin("---", "***", "- - -"), RULE_SCORE)
        .when(trimmed == "", BLANK_SCORE)
        .when(trimmed.rlike(r"^(?:[-*+] |[0-9]+\.[ \t\n\f\r])"), LIST_SCORE)
        .when(number > 0, LINE_SCORE)
        .otherwise(0)
    )


def is_fence(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t]+", "").rlike(r"^(?:```|~~~)")


def bare_words(text: Column) -> Column:
    """Runs of letters, digits and _, with blanks between."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{Nd}_]+", " "))


def split_list(text: Column) -> Column:
    """Trimmed parts of a comma-separated list, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def head(content: Column, size: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("..."))).otherwise(content)


def truncated(content: Column, size: int = RERANK_CHARS) -> Column:
    return F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("…"))).otherwise(content)


def line_range(content: Column, first: int = 1, most: int = 0) -> Column:
    """Lines from number `first` (from 1) on, `most` of them (0: all)."""
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    start = max(1, first)
    length = F.greatest(n - start + 1, F.lit(0))
    return F.array_join(F.when(n >= start, F.slice(lines, start, F.least(length, F.lit(most)) if most else length)).otherwise(F.array().cast("array<string>")), "\n")


#: What stands before a query and before a passage without title, by model family; the last is for all others.
QUERY_PREFIX = {"gemma": "task: search result | query: ", "qwen3": "Instruct: Given a query, retrieve relevant passages that answer the query\nQuery: ", "generic": "", "nomic": "search_query: "}
PASSAGE_PREFIX = {"gemma": "title: none | text: ", "qwen3": "", "generic": "", "nomic": "search_document: "}


def _prefix(family: Column, prefixes: dict[str, str]) -> Column:
    out = F.lit(prefixes["nomic"])
    for name, prefix in prefixes.items():
        out = F.when(family == name, prefix).otherwise(out)
    return out


def query_prompt(family: Column, query: Column) -> Column:
    return F.concat(_prefix(family, QUERY_PREFIX), query)


def document_prompt(family: Column, title_: Column, content: Column) -> Column:
    named = F.coalesce(title_, F.lit(""))
    plain = F.concat(_prefix(family, PASSAGE_PREFIX), content)
    titled = F.when(family == "gemma", F.concat(F.lit("title: "), named, F.lit(" | text: "), content)).when(family.isin("qwen3", "generic"), content).otherwise(F.concat(F.lit("search_document: "), named, F.lit(" — "), content))
    return F.when(named == "", plain).otherwise(titled)


#: Names by which models of a family go.
FAMILIES = {"gemma": "embedding[-_]?gemma", "qwen3": "qwen3[-_]?embedding"}


def family_of(model: str) -> str:
    """prompt_family for a name on the driver."""
    return next((f for f, pattern in FAMILIES.items() if re.search(pattern, model.lower())), "nomic")


def prompt_family(model: Column) -> Column:
    name = F.lower(model)
    out = F.lit("nomic")
    for family, pattern in reversed(FAMILIES.items()):
        out = F.when(name.rlike(pattern), family).otherwise(out)
    return out


def capped(text: Column, size: int = 4000) -> Column:
    """Model input cut to a bounded length (in characters, so that no character breaks)."""
    return F.substring(text, 1, size)


def shares_token(text: Column, query: Column) -> Column:
    """Whether both have an ASCII word in common that is longer than one letter in the query."""

    def parts(x: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9 \t]", " "), "[ \t]+"), lambda w: w != "")

    return F.arrays_overlap(parts(text), F.filter(parts(query), lambda w: F.length(w) > 1))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def plain_text(text: Column) -> Column:
    """Without terminal colour codes."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def human_bytes(n: int) -> str:
    """A size for people, in powers of 1024."""
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        if n >= 1024**power:
            return f"{n / 1024**power:.2f} {unit}"
    return f"{n} B"


def shortened(text: str, width: int) -> str:
    """text in at most `width` characters."""
    return text if len(text) <= width else text[: width - 1] + "…"

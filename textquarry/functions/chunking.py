"""Texts to overlapping chunks that end at natural places.

Cuts fall between lines. Within the last WINDOW tokens before the target the best
break wins: headings before rules, blank lines and list items, all the less the
farther they lie from the target. Fenced blocks are never cut. Source files are
first taken apart into top-level constructs, which stay whole as long as they
fit. Offsets count UTF-8 bytes.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import BLANK_SCORE, FENCE_SCORE, HEADING_SCORES, KIND_EXTENSIONS, LANGUAGE_EXTENSIONS, LINE_SCORE, LIST_SCORE, RULE_SCORE, TOKENS_PER_WORD, UNICODE_SPACE

TARGET, WINDOW, OVERLAP, MOST_OVERLAP = 900, 200, 0.15, 0.5
CHUNK_TYPE = "array<struct<seq:int,start_pos:int,end_pos:int,text:string>>"
_SPACES = re.compile(UNICODE_SPACE + "+")
_HEADING = re.compile(r"(#{1,6}) ")
_ITEM = re.compile(r"[-*+] |[0-9]+\.[ \t\n\f\r]")
_TRIM = re.compile(rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$")

Piece = tuple[int, int, str]


def estimate(text: str) -> int:
    return int(sum(1 for w in _SPACES.split(text) if w) * TOKENS_PER_WORD + 0.5)


def line_value(line: str, number: int) -> int:
    body = _TRIM.sub("", line)
    if heading := _HEADING.match(body):
        return HEADING_SCORES[len(heading[1]) - 1]
    if body in ("---", "***", "- - -"):
        return RULE_SCORE
    if not body:
        return BLANK_SCORE
    if _ITEM.match(body):
        return LIST_SCORE
    return LINE_SCORE if number else 0


def value_at(base: float, distance: float, window: float) -> float:
    if window <= 0:
        return float(base)
    share = min(max(distance / window, 0.0), 1.0)
    return base * (1.0 - share * share * 0.7)


class _Lines:
    """Line starts, running token sums, cut values and fenced line ranges of one text."""

    def __init__(self, raw: bytes):
        parts = re.findall(rb"[^\n]*\n|[^\n]+", raw)
        texts = [x.decode("utf-8", "replace") for x in parts]
        self.starts = [0, *accumulate(map(len, parts))]
        self.sums = [0, *accumulate(map(estimate, texts))]
        self.count = len(parts)
        self.values: list[tuple[int, int]] = []  # (line, value)
        self.fences: list[tuple[int, int]] = []  # byte ranges
        opened = None
        for i, text in enumerate(texts):
            if text.lstrip(" \t").startswith(("```", "~~~")):
                self.values.append((i, FENCE_SCORE))
                if opened is None:
                    opened = self.starts[i]
                else:
                    self.fences.append((opened, self.starts[i + 1]))
                    opened = None
            elif opened is None and (value := line_value(text, i)):
                self.values.append((i, value))
        if opened is not None:
            self.fences.append((opened, len(raw)))

    def line_of(self, at: int) -> int:
        return min(bisect_right(self.starts, at) - 1, self.count - 1)

    def reaching(self, first: int, tokens: int) -> int:
        """The line, from `first` on, with which the tokens are reached; the last one if they never are."""
        return first if tokens <= 0 else min(bisect_left(self.sums, self.sums[first] + tokens, first + 1) - 1, self.count - 1)

    def fence_around(self, at: int) -> tuple[int, int] | None:
        return next((f for f in self.fences if f[0] < at < f[1]), None)


def split_text(content: str, target: int = TARGET, overlap: float = OVERLAP) -> list[Piece]:
    """(start, end, text) of the chunks of a plain or Markdown text."""
    raw = content.encode()
    target = target or TARGET
    overlap = OVERLAP if overlap <= 0 else min(overlap, MOST_OVERLAP)
    if not raw:
        return []
    lines = _Lines(raw)
    out, at = [], 0
    while at < len(raw):
        first = lines.line_of(at)
        if lines.sums[-1] - lines.sums[first] <= target:
            out.append((at, len(raw)))
            break
        aim = lines.reaching(first, target)
        low = lines.starts[lines.reaching(first, target - WINDOW)]
        high = lines.starts[aim + 1]
        cut, best = high, 0.0
        for line, value in lines.values[bisect_left(lines.values, (first, 0)) :]:
            place = lines.starts[line]
            if place > high:
                break
            if place > at and place >= low:
                worth = value_at(value, lines.sums[aim + 1] - lines.sums[line], WINDOW)
                if worth > best:
                    cut, best = place, worth
        if fence := lines.fence_around(cut):
            cut = fence[1]
        cut = len(raw) if cut <= at else min(cut, len(raw))
        out.append((at, cut))
        if cut >= len(raw):
            break
        back = int(estimate(raw[at:cut].decode("utf-8", "replace")) * overlap)
        again = cut
        if back > 0:
            last = lines.line_of(cut - 1)
            aim_sum = lines.sums[last + 1] - back
            again = lines.starts[min(bisect_right(lines.sums, aim_sum) - 1, last)] if aim_sum > 0 else 0
        if again <= at or lines.fence_around(again) or any(f[0] == again for f in lines.fences):
            again = cut
        at = again
    return [(a, b, raw[a:b].decode("utf-8", "replace")) for a, b in out]


def _python_parts(content: str) -> list[tuple[int, int]] | None:
    """Line ranges of top-level statements, decorators and comments included."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in tree.body:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        out.append((first - 1, node.end_lineno or first))
    return out


_STRING = r'"(?:\\.|[^"\\\n])*"'
_CHARACTER = r"'(?:\\u\{?[0-9A-Fa-f]+\}?|\\x[0-9A-Fa-f]{2}|\\[0-7]{1,3}|\\.|[^'\\\n])'"
#: A regular expression stands where a value may begin; elsewhere a slash divides.
_REGEX = r"(?P<lead>(?:^|[(,=:\[!&|?{};]|\breturn\b|=>)[ \t]*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
#: What is no code in a language with braces, beside comments. A lifetime (') has no second quote near it, so it is none of these.
_LITERALS = {
    "go": [r"`[^`]*`", _STRING, _CHARACTER],
    "rust": [r'\bb?r(?P<hashes>#*)".*?"(?P=hashes)', r'"(?:\\.|[^"\\])*"', _CHARACTER],
    "java": [r'"""(?:\\.|[^\\])*?"""', _STRING, _CHARACTER],
    "javascript": [r"`(?:\\.|[^`\\])*`", _STRING, r"'(?:\\.|[^'\\\n])*'", _REGEX],
}
_LITERALS["typescript"] = _LITERALS["javascript"]
_NOISE = {lang: re.compile("|".join([r"//[^\n]*", r"(?P<block>/\*)", *literals]), re.S | re.M) for lang, literals in _LITERALS.items()}


def bare_code(content: str, lang: str) -> str:
    """content with comments as blanks and literals as x, in brackets if they have several lines; as long as before. Block comments of Rust nest."""
    out, at = [], 0
    while m := _NOISE[lang].search(content, at):
        lead = m.groupdict().get("lead") or ""
        out.append(content[at : m.start()] + lead)
        end, filler = m.end(), "x"
        if m["block"]:
            depth, filler = 1, " "
            while depth and (mark := re.compile(r"/\*|\*/").search(content, end)):
                depth += (1 if lang == "rust" else 0) if mark[0] == "/*" else -1
                end = mark.end()
            end = len(content) if depth else end
        elif m[0].startswith("//"):
            filler = " "
        blank = re.sub(r"[^\n]", filler, content[m.start() + len(lead) : end])
        if filler == "x" and "\n" in blank:  # no construct ends inside a literal
            blank = f"({blank[1:-1]})"
        out.append(blank)
        at = end
    return "".join(out) + content[at:]


def _brace_parts(content: str, lang: str) -> list[tuple[int, int]]:
    """Line ranges of top-level constructs of languages with braces; literals and comments do not count."""
    bare = bare_code(content, lang)
    out, depth, first = [], 0, None
    for i, line in enumerate(bare.split("\n")):
        if line.strip() and first is None:
            first = i
        depth += sum(line.count(c) for c in "{([") - sum(line.count(c) for c in "})]")
        if first is not None and depth <= 0:
            ahead = line.rstrip()
            if ahead.endswith((",", "=", "\\")):
                continue
            out.append((first, i + 1))
            first, depth = None, 0
    if first is not None:
        out.append((first, bare.count("\n") + 1))
    return out


#: What may begin a chunk, by language.
_BOUNDARY = {
    "go": r"func\b|type\b|import\b|package\b|const\b|var\b|//|/\*",
    "python": r"(?:async\s+)?def\b|class\b|@|import\b|from\b|#",
    "typescript": r"(?:async\s+)?function\b|(?:abstract\s+)?class\b|interface\b|type\b|import\b|export\b|const\b|let\b|//|/\*",
    "javascript": r"(?:async\s+)?function\b|class\b|import\b|export\b|const\b|let\b|var\b|//|/\*",
    "java": r"(?:public|protected|private|static|final|abstract|class|interface|import)\b|//|/\*",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:fn|impl|struct|enum|trait|use|mod|const)\b|//|/\*",
}


def split_code(content: str, lang: str, target: int = TARGET, overlap: float = OVERLAP) -> list[Piece]:
    """Chunks of a source file: whole top-level constructs up to the target, larger ones split as text."""
    raw = content.encode()
    target = target or TARGET
    parts = (_python_parts(content) if lang == "python" else _brace_parts(content, lang)) if lang in _BOUNDARY else None
    if not parts:
        return split_text(content, target, overlap)
    starts = [0, *accumulate(len(x) + 1 for x in raw.split(b"\n"))]
    out: list[Piece] = []
    begin = held = 0

    def flush(end: int) -> None:
        text = raw[begin:end].decode("utf-8", "replace")
        if estimate(text):
            out.append((begin, end, text))

    for first, last in parts:
        low, high = starts[first], min(starts[last], len(raw))
        if low < begin:
            continue
        text = raw[low:high].decode("utf-8", "replace")
        size = estimate(text)
        if size > target:
            flush(low)
            out += [(low + a, low + b, t) for a, b, t in split_text(text, target, overlap)]
            begin, held = high, 0
            continue
        if held and held + size > target and re.match(_BOUNDARY[lang], text.lstrip()):
            flush(low)
            begin, held = low, 0
        held += size
    flush(len(raw))
    return out or split_text(content, target, overlap)


def split_file(content: str | None, path: str, strategy: str = "auto", target: int = TARGET, overlap: float = OVERLAP) -> list[Piece]:
    """By strategy: `regex` splits as text, `ast` as code, anything else as code only what is code."""
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    lang = next((k for k, known in LANGUAGE_EXTENSIONS.items() if ext in known), "")
    if not content:
        return []
    if strategy == "ast" or (strategy != "regex" and ext in KIND_EXTENSIONS["code"] and lang):
        return split_code(content, lang, target, overlap)
    return split_text(content, target, overlap)


def chunks_of(content: Column, path: Column, strategy: str = "auto", target: int = TARGET, overlap: float = OVERLAP) -> Column:
    """The chunks of each text, as one Arrow batch function."""

    @F.pandas_udf(CHUNK_TYPE)
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[{"seq": i, "start_pos": a, "end_pos": b, "text": t} for i, (a, b, t) in enumerate(split_file(c, p or "", strategy, target, overlap))] for c, p in zip(texts, paths, strict=True)])

    return run(content, path)


def chunk_documents(docs: DataFrame, key: str = "doc_key", strategy: str = "auto", target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """key, seq, start_pos, end_pos, text and content_hash of every chunk of docs (key, path, content)."""
    each = docs.select(key, F.explode(chunks_of(F.col("content"), F.col("path"), strategy, target, overlap)).alias("c"))
    return each.select(key, "c.seq", "c.start_pos", "c.end_pos", F.col("c.text").alias("text"), F.sha2(F.col("c.text").cast("binary"), 256).alias("content_hash"))

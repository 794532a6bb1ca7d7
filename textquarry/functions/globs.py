"""Path patterns with **, *, ?, [..] and {a,b}, as regular expressions."""

from __future__ import annotations

from pyspark.sql import Column

#: Fixed value: the files a collection takes unless told otherwise.
DEFAULT_GLOB = "**/*.{txt,md,go,ts,tsx,js,jsx,py,java,rs,rb,php,c,cpp,h,hpp,cs,swift,kt,scala,sql,sh,bash,yaml,yml,toml,json,xml,html,css,scss,proto,graphql,tf,hcl,Dockerfile}"


def has_pattern(path: str) -> bool:
    return any(c in path for c in "*?[{")


def to_regex(pattern: str) -> str:
    """A whole-path regular expression that Java and RE2 both read."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = end + 1
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        else:
            out.append("\\" + c if c in ".^$+()|[]{}\\" else c)
        i += 1
    return "^" + "".join(out) + "$"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(to_regex(pattern))

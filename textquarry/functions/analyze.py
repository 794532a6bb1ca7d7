"""Analyzers: texts to index terms.

`simple` lower-cases and takes runs of letters and digits, in plain SQL
functions. `porter` also folds diacritics and stems with Porter's 1980 algorithm
(from the paper), in an Arrow batch function.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMPLE_TOKEN = r"[\p{L}\p{N}]+"


def simple_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SIMPLE_TOKEN), F.lit(0))


def _measure(s: str) -> int:
    """Number of vowel-consonant steps."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(s))))


def _shape(s: str) -> str:
    out = ""
    for i, c in enumerate(s):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _short(s: str) -> bool:
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


#: The suffix rules of steps 2 to 4 in the paper.
_STEP_2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log bli:ble".split())
_STEP_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
del _STEP_2["abli"]  # the author's own revision writes bli for it


def _replaced(word: str, rules: dict[str, str]) -> str:
    for end in sorted((e for e in rules if word.endswith(e)), key=len, reverse=True):
        base = word[: -len(end)]
        return base + rules[end] if _measure(base) > 0 else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    """Porter's stem; words of 3 to 64 bytes only, others stay."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    w = word.encode().decode("latin-1")  # letters beyond ASCII count as consonants, one for each byte
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else ""
        base = w[: -len(end)] if end else w
        if end and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif _double(base) and base[-1] not in "lsz":
                w = base[:-1]
            elif _measure(base) == 1 and _short(base):
                w = base + "e"
            else:
                w = base
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, _STEP_2)
    w = _replaced(w, _STEP_3)
    for end in sorted((e for e in _STEP_4 if w.endswith(e)), key=len, reverse=True):
        base = w[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
            w = base
        break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode("utf-8", "replace")


@lru_cache(200_000)
def _folded(c: str) -> str:
    """A letter or digit in lower case without diacritics; '' for a separator."""
    kind = unicodedata.category(c)
    if kind[0] == "M":
        return c if kind == "Mn" else ""
    if kind[0] not in "LN" and kind != "Co":
        return ""
    plain = unicodedata.normalize("NFD", c.lower())
    return plain[0] if len(plain) > 1 and all(unicodedata.category(x) == "Mn" for x in plain[1:]) else c.lower()


def porter_tokens(text: str | None) -> list[tuple[str, int, int]]:
    """(term, start, end) of each token, in characters."""
    out, start, word = [], -1, []
    for i, c in enumerate((text or "") + " "):
        low = _folded(c) if i < len(text or "") else ""
        if low and (start >= 0 or unicodedata.category(c) != "Mn"):
            if start < 0:
                start = i
            if unicodedata.category(c) != "Mn":
                word.append(low)
        elif start >= 0:
            out.append((stem("".join(word)), start, i))
            start, word = -1, []
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_terms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [term for term, _, _ in porter_tokens(t)])


ANALYZERS = {"simple": simple_terms, "porter": porter_terms}


def query_terms(text: str, analyzer: str) -> list[str]:
    """The terms of one query clause, on the driver."""
    if analyzer == "porter":
        return [term for term, _, _ in porter_tokens(text)]
    return [t for t in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split(" ") if t]

"""What a user types into a search box, as clauses: words, "phrases", -negations."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Fillers that long queries drop (English, contraction ends, Turkish).
STOPWORDS = frozenset(
    "a about after all an and any are as at be been before being both but by can could did do does during each for from had has have having he her here his how "
    "i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their "
    "them then there these they this those through to too under until up us very was we were what when where which while who why will with would you your "
    "ain aren couldn didn doesn don hadn hasn haven isn shouldn wasn weren won wouldn d ll m re s t "
    "bir bu çok da daha de en için ile ki kim mi mı mu mü ne ni nin o şu ve veya ya".split()
)
#: A query with more plain words than this drops its fillers.
KEEP_FILLERS_UP_TO = 3
#: One unit: blanks, an optional lone minus, then a quoted run (to the end if unclosed) or a run without blanks and quotes.
_UNIT = re.compile(r'(?P<minus>-(?=[^ \t\n\r-]))?(?:"(?P<phrase>[^"]*)(?:"|$)|(?P<bare>[^ \t\n\r"]+))')
_OPERATORS = {"and", "or", "not", "near"}


@dataclass(frozen=True)
class Clause:
    text: str
    phrase: bool = False
    negated: bool = False

    def __str__(self) -> str:
        return f'"{self.text}"' if self.phrase else self.text


def _pieces(text: str) -> list[str]:
    """Runs of letters, decimal digits and underscores."""
    return "".join(c if c.isalpha() or c.isdecimal() or c == "_" else " " for c in text).split(" ")


def parse(query: str) -> list[Clause]:
    """Every clause in order, fillers included."""
    out = []
    for unit in _UNIT.finditer(query):
        negated = unit["minus"] is not None
        found = [p for p in _pieces(unit["bare"] if unit["phrase"] is None else unit["phrase"]) if p]
        if unit["phrase"] is not None:
            out += [Clause(" ".join(found), True, negated)] if found else []
        else:
            out += [Clause(p.lower() if p.lower() in _OPERATORS else p, False, negated) for p in found]
    return out


def effective(query: str) -> tuple[list[Clause], list[Clause]]:
    """Wanted and unwanted clauses; both empty if nothing wanted is left."""
    clauses = parse(query)
    plain = [c for c in clauses if not c.phrase and not c.negated]
    drop = {c for c in plain if c.text.lower() in STOPWORDS} if len(plain) > KEEP_FILLERS_UP_TO else set()
    wanted = [c for c in clauses if not c.negated and c not in drop]
    return (wanted, [c for c in clauses if c.negated]) if wanted else ([], [])


def normalised(query: str) -> str:
    """The query in its canonical form, '' if it asks for nothing."""
    wanted, unwanted = effective(query)
    return " ".join(map(str, wanted)) + "".join(f" NOT {c}" for c in unwanted)


def split_collections(names: str | None) -> list[str]:
    return [x.strip() for x in (names or "").split(",") if x.strip()]


def parse_document_spec(spec: str) -> tuple[str, int]:
    """`path:42` as path and line; line 0 if there is none."""
    path, colon, line = spec.rpartition(":")
    return (path, int(line)) if colon and re.fullmatch(r"[+-]?[0-9]+", line) else (spec, 0)


def parse_context_spec(spec: str) -> tuple[str | None, str]:
    """`/` is everything, `c` a collection, `c/p` a path in it; a scheme before it does not count."""
    spec = re.sub(r"^[a-z]+://", "", spec)
    if spec in ("", "/"):
        return None, "/"
    name, _, path = spec.partition("/")
    return name, path or "/"

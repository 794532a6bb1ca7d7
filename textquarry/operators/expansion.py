"""Query expansion: a generator's lines to lexical, vector and hypothetical-document variants."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import shares_token

#: The prompt's wording and the length of the answer.
PROMPT, INTENT, ANSWER_TOKENS = "/no_think Expand this search query: ", "\nQuery intent: ", 256
KINDS = ("lex", "vec", "hyde")


class Generator(Protocol):
    def generate(self, prompt: str, max_tokens: int) -> str: ...


class CannedGenerator:
    """Always the same answer; for tests and offline use."""

    def __init__(self, answer: str):
        self.answer = answer

    def generate(self, prompt: str, max_tokens: int) -> str:
        return self.answer


def prompt_for(query: str, intent: str = "") -> str:
    return PROMPT + query + (INTENT + intent if intent else "")


def automatic_intent(intent: str, collections: list[str], contexts: dict[str, str]) -> str:
    """The given intent, else the context of the one collection that is searched."""
    return intent or (contexts.get(collections[0], "") if len(collections) == 1 else "")


def variants(answers: DataFrame, with_lexical: bool = True) -> DataFrame:
    """query_id, kind, line_no, content of every usable line of answers (query_id, query, answer).

    A line reads `kind: content`. A lexical variant counts only if it shares a
    word with the query; unknown kinds and empty contents are dropped.
    """
    lines = answers.select("query_id", "query", F.posexplode(F.split("answer", "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^[\t\r ]+|[\t\r ]+$", "")))
    cut: Column = F.instr("line", ":")
    parts = lines.filter(cut > 1).select("query_id", "query", "line_no", F.lower(F.trim(F.expr("substring(line, 1, instr(line, ':') - 1)"))).alias("kind"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("content"))
    usable = parts.filter((F.col("content") != "") & F.col("kind").isin(*KINDS))
    lexical = F.lit(with_lexical) & shares_token(F.col("content"), F.col("query"))
    return usable.filter((F.col("kind") != "lex") | lexical).select("query_id", "kind", "line_no", "content")

import random

import pytest

from textquarry.llm.common import clear_scratch

WORDS = [f"{a}{b}" for a in ("ba", "de", "ko", "lu", "mi", "no", "ra", "se", "ti", "vo") for b in ("n", "rt", "sk", "ll", "mer", "tion", "x", "dle")]
EXTRA = "size long, shard int, slot long, label string, rep long, spans string, block long, start long, target double, kept boolean, node long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, very long, repeated and near texts, ties and null columns."""
    draw = random.Random(5)
    rows = [(i, sentence(draw, draw.randint(5, 160)), draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", "é"])) for i in range(60)]
    rows += [(60, None, None, None), (61, "", "en", "a"), (62, " \n\t ", "en", None), (63, sentence(draw, 20_000), "fr", "b"), (None, "no id here", "en", "a")]
    rows += [(64, rows[3][1], "en", "a"), (65, rows[3][1], "en", "b"), (65, rows[3][1], "en", "b"), (66, rows[4][1] + " tail", "en", "c")]
    rows += [(100 + i, rows[7][1], "en", "hot") for i in range(60)]
    base = sentence(draw, 120).split()
    for i in range(50):
        words = list(base)
        words[draw.randrange(120)] = "edit"
        rows.append((200 + i, " ".join(words), "en", "near"))
    rows += [(300, "1\x0b2\x0c3 4  x", "en", "a"), (301, "É́ ＡＢ 😀 ß", "fr", "a"), (302, "one", "en", "a"), (303, "one", "en", "a"), (304, "two words", "en", "a")]
    return rows


def frame(spark, rows, extra: bool = True):
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA).repartition(5)
    if extra:
        for field in EXTRA.split(", "):
            name, kind = field.split()
            docs = docs.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return docs


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    yield
    clear_scratch(spark)


@pytest.fixture(scope="session")
def odd(spark):
    return odd_rows()


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    return frame(spark, odd).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Columns that clash with names inside the operators.
CLASHES = ["tk", "key", "node", "line", "root", "anchor", "cls", "at", "first", "_id", "_key", "_tk", "_numbers", "_own", "_doc", "_ranges",
           "digest", "maybe", "score", "lang_pred", "letters", "items", "starts", "counts", "label", "ids", "body", "_digest", "_gone", "_words"]


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Été", "ño", "of", "the", "line", "x", "seven", "ß"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, copies, a very long text, white space of all kinds, periodic texts, shared passages."""
    rng = random.Random(7)
    passage, other = words(rng, 70), words(rng, 65)
    rows = [(i, words(rng, rng.randint(1, 60)) + "\n" + words(rng, 12)) for i in range(10, 40)]
    rows += [(100 + i, f"{words(rng, 20)} {passage}\n{words(rng, 9)} {i}") for i in range(12)]
    rows += [(200 + i, f"{other}\n\n{passage} {words(rng, 30)}") for i in range(3)]
    rows += [(300, None), (301, ""), (302, " \t\n \r\n"), (303, "!!! ... ---"), (304, "a"), (305, "One two three"), (306, "one TWO three")]
    rows += [(310, rows[0][1]), (311, rows[0][1].upper()), (312, rows[3][1]), (9, rows[3][1])]
    rows += [(320, "ab" * 400), (321, "x " * 300), (322, "ab" * 300 + "c"), (323, " \x85\xa0 　 a\x1cb  c \x00 d\r\n\te"), (324, "don't  we'll 12,345.67  \U0001f600\U0001f600 naïve\n\n\n")]
    rows += [(330, "\n".join(words(rng, 15) for _ in range(400)) + "\n" + passage)]
    rows += [(340 + i, passage.replace("gamma", "omega", i) + " " + other) for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table with clashing columns, which hold nulls."""
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, None, None) for i, t in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.when(F.col("doc_id") % 2 == 0, F.lit(name)).alias(name) for name in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def tied_docs(spark):
    """Repeated rows, rows that share only the id, and missing ids."""
    text = "the quick brown fox jumps over the lazy dog and runs on " * 12
    rows = [(1, text), (1, text), (1, "another text of id one"), (None, text + "end"), (None, None), (2, text), (2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

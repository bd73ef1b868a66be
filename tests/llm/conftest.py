import random

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"

#: Texts that are hard for one operator or another.
EDGES = [
    None,
    "",
    " ",
    "\n\n \t\r\n",
    "one",
    "one two three four",
    "Don't  stop — İstanbul naïve ﬁ Ⅷ 北京 日本語  x y",
    "a<|endoftext|>b <|startoftext|> <|x <| |>",
    "▁ a▁b ▁\n ▁",
    "🙂🙃 é \u0000 ﻿ x​y",
    "word " * 3000,
    "x" * 30000,
    " \n" * 2000 + "end",
    "1 2  3\n\n4\t5 a1b2 3.14 $5 #tag don't can't I'll",
    "the same line\nthe same line\nthe same line",
]


@pytest.fixture(scope="session")
def texts():
    """Edge cases, whole documents, and random mixtures, some repeated."""
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "ß", "7", " ", "  ", "\n", "'", "'s", "_", "-", ".", "▁", "<|", "|>", "🙂", " ", "the", "ing", "\t", "İ", "́"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    whole = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    return EDGES + mixed + whole + whole[:5]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns of clashing names; one id is null, one row is repeated."""
    rows = [(None if i == 3 else i, t, "en", "web", i, "x", 1) for i, t in enumerate(texts)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id int, _text string, ids int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def bag(rows):
    """Rows in an order that does not depend on where they came from."""
    return sorted((tuple(r) for r in rows), key=repr)

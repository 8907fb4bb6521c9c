"""Fixtures for the operators on training text."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, _row string, fingerprint string, text_length int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "the", "ou", "st", "re", "ly"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank and long texts, repeats, and columns whose names clash with results."""
    base = words(1, 400)
    texts = [None, "", " \n\t ", "x", base, base, base + " end", words(2, 30_000), "é" * 900, "ab" * 2000, "\x00" * 500, "😀 " * 300, base[:300]]
    rows = [(i if i != 5 else 4, t, "en" if i % 3 else None, None, None, None, None, "r", "f", 1) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(13)] + [(None, 1, 1), (3, None, None), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]

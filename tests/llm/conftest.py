"""Sessions and small tables for the tests of the corpus operators."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table of (doc_id, text) or (doc_id, text, source)."""

    def build(*rows, source="s"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCUMENTS))


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    """Invented words with a few frequent ones."""
    import random

    pick = random.Random(seed)
    return " ".join(f"w{int(vocabulary * pick.random() ** 3)}" for _ in range(words))

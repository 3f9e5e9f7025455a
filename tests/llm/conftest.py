"""Small tables for the training-data operators."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns an operator may use inside; here they clash on purpose.
CLASH = "body string, block long, key long, seq long, fp long, score double, n_tokens long, g string, row long, d double, kept boolean, w string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    rows = [
        (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \t\n ", None, "s", 4), (4, long, "en", None, len(long)), (5, "one", "en", "s", 3), (6, "one", "en", "s", 3), (6, "one", "en", "s", 3),
        (None, "no id here at all but some words", "en", "s", 5), (7, "é日本<|endoftext|>▁ \x00 ok", "fr", "s", 9), (8, "### $$$ 123 456", None, None, None), (9, words(rng, 400), "de", "t", 1), (10, "A.\nA.\nA.\n", "de", "t", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

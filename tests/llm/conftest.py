from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone bread license under mit token cloud seven water green apache version 2 cc by nc".split()


def prose(rng: random.Random, count: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(count))


EDGE_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, spans string,"
    " host string, bucket string, body string, row string, _gone string, _id string, _hash string"
)


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 60)
    texts = [
        None, "", " \n\t ", "one", "two words", base, base, base.replace("river", "canal", 1), "x" * 70_000,
        prose(rng, 30_000), "é ñ 你好 𝒳 ▁ \x00   end", "A" * 3 + "\n" + "a" * 3, "Under the MIT License. " * 3,
        "mail bob@example.org, +49 30 1234567 or 192.168.0.1; password=hunter22 token: abc", base.upper(),
    ]
    rows = [(k, t, "en", f"src{k % 3}", len(t) if t else None) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, None, None, None, None), (None, base, None, None, 1), (5, "another text of id five", "en", None, 0)]
    return [(*r, "x", "y", None, "h", "b", "c", "r", "g", "i", "x") for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)

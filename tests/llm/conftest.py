import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc_key string, score double, epoch int, class string"
WORDS = "the quick brown fox jumps over one lazy dog while seven green birds watch from tall old trees near a calm river bank at dawn".split()


def sentence(seed: int, count: int) -> str:
    """Words in an order of its own for every seed."""
    out, state = [], seed * 2654435761 % 2**32
    for _ in range(count):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append(f"{WORDS[(state >> 16) % len(WORDS)]}{(state >> 8) % 50 or ''}")
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and clashing columns."""
    base = sentence(1, 120)
    long = " ".join(sentence(k, 2000) for k in range(30, 50))
    texts = [
        (1, base), (2, base), (3, base.replace("the", "The,")), (4, base + "\n" + sentence(2, 40)), (5, None), (6, ""), (7, "  \n\n "), (8, "!!! ???"),
        (9, long), (9, long), (10, sentence(3, 60)), (10, sentence(4, 60)), (None, sentence(5, 50)), (None, None), (11, "one"), (12, "one"), (13, sentence(2, 40)),
    ]
    rows = [Row(k, t, None if k in (3, None) else "en", None if k in (4, 5) else f"s{(k or 0) % 3}", None, "r", "k", 0.5, 7, "c") for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

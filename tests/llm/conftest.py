import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts: make_docs(spark, texts)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, repeated, very long, non-ASCII and junk texts."""
    rng = random.Random(7)
    base = words(rng, 120)
    return [None, "", "", " ", "\n\n\t", base, base, base.upper(), "é" * 300, "日本語 текст العربية 🙂🙂", "a" * 5000, words(rng, 9000, 400), base + " tail", "x", "'s don't  we'll", "1234 5678 9 z", "\x00\x01\x1c\x85"]

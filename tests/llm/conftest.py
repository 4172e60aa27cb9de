import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, fp string, bucket string"
LONG = "word " * 60_000


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward rows: nulls, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta,", "epsilon.", "été", "ß", "日本語", "x1", "#tag"]
    texts = [None, "", " \t\n", "one", "one two", LONG, "Same text here", "Same  text\there", "same text here"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    texts += ["line one\nline two\nline one\n\nline one", "a b c d a b c a b c", "<|endoftext|> and <|endoftext|>", " nbsp x  y"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None, "k", "z", "f", "b") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, "s1", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(1000 + i, "hot text of many copies", "en", "hot", 1, "k", "z", "f", "b") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

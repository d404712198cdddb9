import random

import pytest


@pytest.fixture(scope="session")
def documents_of(spark):
    """Documents table of texts, with extra columns whose names could clash."""

    def build(texts, langs=None, ids=None):
        rows = [
            (None if ids and ids[i] is None else (ids[i] if ids else i), t, langs[i] if langs else "xx", f"src{i % 3}", len(t or ""), "x", i)
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string, kept long")

    return build


@pytest.fixture(scope="session")
def prose():
    """Random sentences from a small vocabulary."""

    def make(seed, words=200, alphabet="abcdefghij"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(words))

    return make


ODD = [None, "", " \n\t ", "one", "one", "a b c d", "É " * 3, "x" * 50_000, "word " * 20_000]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD)

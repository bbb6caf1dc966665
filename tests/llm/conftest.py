import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, label int, words int, id long"


def frame(spark, texts, start=0):
    """Documents with more columns whose names clash with those that operators use. ``texts``: strings or (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", 0, 0.5, "x", 1, 2, 3) for i, t in rows], DOCS)


@pytest.fixture
def docs(spark):
    return lambda texts: frame(spark, texts)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def prose():
    """Seeded invented prose: prose(n) has n words."""
    rnd = random.Random(5)
    syllables = ["ba", "re", "ti", "on", "the", "ing", "ou", "é", "st", "lo"]
    vocabulary = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    return lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))


def records(df):
    return df.toArrow().to_pylist()

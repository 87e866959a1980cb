import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Texts of all kinds: ordinary, empty, null, one word, long, copies, near copies, other scripts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ing", "é", "ß", "ion"]) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 120))) for _ in range(60)]
    base = [word() for _ in range(200)]
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + ["", None, "one", "two words", "   ", "A\tB\nC\u00a0D", "你好 世界 再见", "x " * 3000, " ".join(word() for _ in range(9000)), "don't <|endoftext|> stop\n\n  now", texts[3].upper()]
    return texts


@pytest.fixture(scope="session")
def docs(spark, prose):
    rows = [(i * 3, t, "en" if i % 3 else None, f"src{i % 4}", len(t or "")) for i, t in enumerate(prose)]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "score_of_old").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null texts, repeated rows, equal ids with other texts."""
    rows = [(None, "a b c d e f", None, None, None), (None, None, None, None, None), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "other words in this row", "en", "s", 1), (9, "", "en", "s", 1), (-4, "a b c d e f", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

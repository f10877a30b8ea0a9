import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, r1 string, h1 string, bucket int, label string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty texts, repeats, shared ids, letters beyond ASCII, a very long text."""
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 80)
    near = " ".join(a.split()[:-1] + ["zzz"])
    texts = [
        (1, a), (1, a), (2, a), (3, near), (4, b + "\n" + a), (5, None), (6, ""), (7, "   \n\t\n"), (8, "A\nb\nA "), (9, "Élan vital Straße\nÉlan vital straße"),
        (None, a), (None, None), (10, "x"), (11, words(rng, 60_000)), (12, a.upper()), (12, b), (13, "123 456 789 000 111 222"), (14, "the same line\n" * 300), (15, "\u0000￿ nul"),
    ]
    return [(i, t, "en" if k % 3 else None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t), 0.5, "r", "h", k, "l") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Documents with awkward rows and with extra columns named like inner ones."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "row bigint, fingerprint string, flags string, size string, key string, text_ string, times_taken string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    """A few hundred texts with exact copies, near copies and shared lines."""
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        texts.append("\n".join(words(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6))))
    for i in range(60):
        base = texts[i % 20].split(" ")
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = words(rng, 1)
        texts.append(" ".join(base))
    for i in range(40):
        line = texts[i % 7].split("\n")[0]
        at = rng.randrange(len(line) + 1)
        texts.append(words(rng, 8) + "\n" + line[:at] + rng.choice("xyz") + line[at:] + "\n" + words(rng, 5))
    return texts


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names."""
    rng = random.Random(9)
    long = words(rng, 60_000)
    rows = [
        (1, "", "en", "a", 0),
        (2, None, "en", "a", None),
        (None, "no id at all here", None, "b", 3),
        (4, "same text twice in the table", "de", None, 5),
        (4, "same text twice in the table", "de", None, 5),
        (5, " \n\t \n", "en", "b", 5),
        (6, long, "en", "a", len(long)),
        (7, "ÄÖÜ ß 日本語 👍 é x　y end.\r\nNext  line  ", "de", "b", 1),
        (None, None, None, None, None),
        (8, "same text twice in the table", "de", "c", 5),
    ]
    rows = [(*r, i, "f", "g", "h", "k", "t", "n") for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"{COLUMNS}, {CLASHING}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASHING}")


@pytest.fixture(scope="session")
def documents(spark, prose):
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(prose)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)

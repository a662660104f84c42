import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, t string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with every trouble at once: NULLs, empty and very long texts, repeated rows, clashing columns."""
    long = words(9, 30_000)
    rows = [(1, words(1, 120)), (2, words(2, 80)), (2, words(2, 80)), (None, words(3, 60)), (4, None), (5, ""), (6, "  \n "), (7, "?!"), (8, long), (9, words(1, 120)), (None, None), (10, "eins"), (11, "漢字 é 😀")]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", None if i == 4 else f"s{(i or 0) % 2}", None, "k", 0, "t") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

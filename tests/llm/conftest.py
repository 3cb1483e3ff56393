import random

import pytest

SYLLABLES = "ka lo mi ren tas ver un do si pel gar nu bo ri".split()


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and non-Latin texts, ties, and columns whose names may clash."""
    long_ = prose(1, 30_000)
    texts = [None, "", "  \n\t ", prose(2, 120), prose(2, 120), long_, "Ünïcødé ﬀ 漢字 " * 40, prose(3, 60) + "\n" + prose(4, 60), "a", "x " * 500, prose(5, 80).upper() + "!!", "<|endoftext|> a b  c\n\n d"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", 7, "c", "r") for i, t in enumerate(texts)]
    return [*rows, (None, "no id " * 30, None, None, 1, "c", "r")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, row_id string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def frame(texts, start=0):
        return spark.createDataFrame([(start + i, t, "en", f"s{i % 2}", len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(4)

    return frame

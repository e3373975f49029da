import pytest

LONG = ("Word number one thousand and more of them. " * 3000).strip()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, key string, fp long, d long, s string, h string, node long, shard int, toxicity double, _own string"


def rows(values):
    """(doc_id, text, source) with columns whose names clash with the operators' own."""
    return [(i, t, None if src is None else "en", src, None, "row", 7, "key", 7, 7, "s", "h", 7, 7, 7.0, "own") for i, t, src in values]


EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "a"),
    (2, None, None),
    (3, "", "b"),
    (4, LONG, "b"),
    (5, "one", None),
    (None, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "a"),
    (None, None, None),
    (6, "éè \U0001f600́ \t\n\n x\x00y", "é"),
    (7, " \n ", "b"),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(rows(EDGES), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, "If Alice has 12 apples and gives Bob 5 apples how many apples does Alice have left."), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")

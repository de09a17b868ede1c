import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, block int, fp string, rank int, w string, lines int, n int, at string, `__id` int, part string, h int, u int, bin int, shard string"


def rows_of(texts, start=0):
    return [(None if t[0] is None else t[0], t[1], "en", t[2] if len(t) > 2 else "a", 1, "k", "z", 1, "f", 2, "w", 3, 4, "at", 5, "p", 6, 7, 8, "s") for t in texts]


PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew coffee near the old harbour wall. " * 3
LONG = " ".join(f"word{i} and then some{i % 97}" for i in range(60_000)) + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, blank, short, very long and repeated texts, ties, and columns with the operators' own names."""
    texts = [(1, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \t\n "), (6, "Of."), (7, LONG, None), (8, PROSE + "One more line here."), (9, "x" * 300), (None, PROSE), (10, "é" * 80 + " ü 中文 words", "b"), (1, PROSE), (11, None, None), (12, "\x00a\x00b ퟿ ok")]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)

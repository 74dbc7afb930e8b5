"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. All of it.", "en", "a", 68),
    (2, None, "en", "b", 0),
    (3, "", None, None, 0),
    (4, "   \n\t \n", "fr", "c", 7),
    (5, "one", "en", "a", 3),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. All of it.", "en", "b", 68),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. All of it.", "en", "b", 68),
    (7, "12345 !!! ### 678", "de", "d", 17),
    (None, "A row without a number, told from others by its text only.", "en", "e", 57),
    (8, "<|endoftext|> it's a b 　c\u0085d \x01 é é 日本語テスト \U0001f600", "en", "f", 50),
    (9, "word " * 30000 + "x" * 5000, "en", "a", 155000),
    (-10, "same line here.\nsame line here.\nsame line here.\nsame line here.\nother words.", "en", "a", 70),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for what they add or for themselves.
CLASHING = ["score", "kept", "n_words", "_id", "part", "n_lines", "length", "key"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def odd_wide(odd):
    from pyspark.sql import functions as F
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)

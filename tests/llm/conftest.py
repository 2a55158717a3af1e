import pytest

#: Rows that every operator must take: nulls, empty and odd texts, ties, repeated rows, repeated ids.
WORDS = " ".join(f"word{i % 97} of{i % 89} text{i}" for i in range(400))
ROWS = [
    (1, WORDS, 7, "a"),
    (2, WORDS, None, "a"),
    (3, WORDS.replace("text7 ", "other "), 7, None),
    (4, None, 7, "a"),
    (5, "", 7, "a"),
    (6, " \t\n ", 7, "a"),
    (7, "one two", 7, "a"),
    (8, "One TWO", 7, "a"),
    (9, "ünïcödé 漢字 😀 " * 40, 7, "a"),
    (10, "ab" * 3000, 7, "a"),
    (11, "line of text\n" * 200, 7, "a"),
    (12, WORDS, 7, "a"),
    (12, WORDS, 7, "a"),
    (13, "first text of a repeated id " * 20, 7, "a"),
    (13, "second text of it, unlike the first " * 20, 7, "a"),
    (None, "no id at all " * 30, 7, "a"),
    (14, "<|endoftext|> and 'tis the end's", 7, "a"),
]
SCHEMA = "doc_id long, text string, n int, _key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names the operators use inside."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

import pytest

#: doc_id, text, lang
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n\x0b\x0c\r ", "fr"),
    (6, "word", "fr"),
    (7, "Ünïcödé tèxt — 漢字 🎉 é İ Σ ſ", None),
    (8, "x" * 70_000, "de"),
    (9, ("long text with many words of all sorts " * 4000).strip(), "de"),
    (10, "<|endoftext|> gnu general public license\n\n\nMIT License.\r\nmit license", "en"),
    (10, "another row of the same id", "en"),
    (11, "repeated row", "en"),
    (11, "repeated row", "en"),
    (None, "no id here at all, sorry", "en"),
]
SCHEMA = "doc_id bigint, text string, lang string, ids string, n_words string, kept string, leaks int, h int, node int, n_lines int, ref string, spans string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, long texts, ties, repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame([(*r, "i", "w", "k", 1, 2, 3, 4, "r", "s", "c") for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

import pytest

#: Texts that every operator on texts must take: null, empty, blank, repeated, very long, symbols, several scripts.
HARD = [None, "", "   \n\t ", "a", "a", "word " * 30_000, "x" * 200_000, "é漢字 ß ñ", "!!! ??? ...", "password: hunter2hunter2hunter2", "�\U0001f600" * 500]


@pytest.fixture
def hard(spark):
    """Documents with hard texts, a null id, a repeated row and extra columns with clashing names."""
    rows = [(k, t, "en", k) for k, t in enumerate(HARD)] + [(None, "no id", None, None), (3, "a", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, node int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, node int")

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies and clashing extra columns."""
    words = [f"w{k}" for k in range(400)]
    long = " ".join(words)
    near = " ".join(words[:200] + ["x"] + words[201:])
    rows = [
        (1, "The cat sat on the mat and the dog ran.", "en", "a", 1, "k", 0), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "k", 1), (4, "  \n\t ", "en", "a", 5, "k", 1),
        (5, long, "en", "b", len(long), "k", 1), (6, long, "en", "b", len(long), "k", 1), (6, long, "en", "b", len(long), "k", 1), (7, near, "en", "b", len(near), "k", 2),
        (None, "der Hund und die Katze", "de", "c", 3, "k", 2), (None, "der Hund und die Katze", "de", "c", 3, "k", 2), (8, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" é ü 漢字", "de", "c", 9, "k", 3),
        (9, "y" * 30000, "en", "a", 30000, "k", 3), (10, "1234 5678 !!", "en", None, 2, "k", 3), (11, "a b c", "en", "a", 5, "k", 4), (12, "A B C", "en", "a", 5, "k", 4), (13, "<|endoftext|> x  y   z ", "en", "a", 5, "k", 4),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

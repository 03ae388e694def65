import pytest


@pytest.fixture()
def docs(spark):
    """Documents with nulls, empty and repeated texts, ties and a clashing column."""
    rows = [(1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (5, "zz", "de", None, 2), (1, "a b c d e f", "en", "s", 11)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

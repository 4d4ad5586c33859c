import pytest

ODD = [(None, "null id has a text of several words here"), (3, None), (4, ""), (5, "   \n\t"), (6, "x" * 30000), (7, "one two three four five six seven"),
       (7, "one two three four five six seven"), (8, "ONE two three four five six seven"), (9, "word " * 9000)]


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty and blank texts, very long ones, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "k", 2) for i, t in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, key string, `row` int")


@pytest.fixture
def none(odd):
    return odd.limit(0)

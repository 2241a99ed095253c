import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 6000
#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, and a column that clashes with outputs.
HARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "s", 9, 1),
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "s", 9, 1),
    (2, "The quick brown fox jumps over the lazy dog. " * 8, "en", "s", 9, 2),
    (3, None, None, None, None, None),
    (None, "a text without an id, released under the MIT License", "en", "s", 9, 3),
    (None, None, "de", "s", 0, 4),
    (4, "", "en", "s", 0, 5),
    (5, " \n\t ", "fr", "s", 4, 6),
    (6, LONG, "en", "s", len(LONG), 7),
    (7, "x" * 70000, "en", "s", 70000, 8),
    (8, " " * 5000 + "é▁漢字\x00 😀", "de", "s", 5007, 9),
    (9, "one two", "en", "s", 7, 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same rows with a column for each name that operators add."""
    out = hard
    for c in ("score", "evidence", "passages", "ids", "decoded", "shard", "slot", "bucket", "row", "spans", "kept", "n_bytes", "component_id"):
        out = out.withColumn(c, F.lit(7))
    return out

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, own column names in use."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 3, "x"),
        (1, "one two three four five six seven", "en", "a", 3, "x"),
        (2, "One Two three four five six seven", "en", None, None, "x"),
        (3, None, None, None, None, None),
        (None, "one two three four five six seven", None, "b", 1, None),
        (None, None, "de", "b", 1, None),
        (4, "", "de", "b", 0, "y"),
        (5, " \n\t ", "de", "b", 4, "y"),
        (6, "123 456 !!", "de", "b", 4, "y"),
        (7, "der die das und ist nicht ein eine " * 4000, "de", "b", 4, "y"),
        (8, "der die das und ist nicht ein eine " * 4000, "de", "c", 4, "y"),
        (9, "the <|im_end|> and the <|endoftext|> of \x00 it", "en", "c", 4, "y"),
        (9, "another text under the same id", "en", "c", 4, "y"),
        (10, "ab" * 300, "en", "c", 4, "y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    return df.selectExpr("*", "row as maybe", "row as h", "row as digest", "row as copies", "row as bucket",
                         "row as `_gone`", "row as `dotted.name`").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="session")
def same():
    """Equal as bags of rows."""
    def compare(a, b):
        assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
    return compare

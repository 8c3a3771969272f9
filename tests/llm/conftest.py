import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with NULLs, empty and long texts, repeated rows, and columns whose names clash with results."""
    base = "the quick brown fox jumps over the lazy dog and runs away from every hound that it ever saw in town"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, f"{base} today", "b"), (4, None, None), (5, "", "b"), (6, "word", ""),
        (7, "two words", None), (8, "long " * 6000 + "end", "a"), (9, "\x0b \x1c \x85 été 日本 🎉🎉", "c"), (9, "another text", "c"),
        (10, "copy of a row", "c"), (10, "copy of a row", "c"), (None, "no id at all", "a"), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("score", "shard", "size", "kept", "ids", "h", "own", "key", "lang")])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

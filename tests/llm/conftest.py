import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names operators use for their own."""

    def made(pairs):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in pairs], DOCS)

    return made


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, a long one, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \t\n "), (4, "One two three. " * 4000), (5, "a  b\tc\n▁x é\x00 <s> </s> 😀 漢字"), (5, "a  b\tc\n▁x é\x00 <s> </s> 😀 漢字"), (None, "no id here"), (6, "  lead and trail  "), (7, "x" * 3000)]

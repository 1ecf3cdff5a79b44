import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # extra columns whose names an operator might use itself
                     T.StructField("fp", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns nobody asked for."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", "y", "z") for i, t in rows], DOCS)


ODD = [(1, "one two three four five six seven. And eight nine ten"), (2, "one two three four five six seven. And eight nine ten"), (3, None), (4, ""),
       (5, "word " * 40_000), (6, "\u00e9\u4e2d\U0001f600 caf\u00e9\tA-Z"), (7, "x"), (8, "   \n\t "), (9, "one two three four five six seven. And eight nine ten!"), (9, "one two three four five six seven. And eight nine ten!"), (None, "no id")]


@pytest.fixture(scope="session")
def odd():
    """Nulls, an empty and a very long text, ties and a repeated row."""
    return ODD

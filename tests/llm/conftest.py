import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        *[T.StructField(n, T.StringType()) for n in ("size", "key", "shard", "score", "ids", "words", "hash", "kept", "line", "item_id", "start")],
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(doc_id, text)`` pairs, with null and clashing further columns."""

    def make(pairs, slices=3):
        rows = [(i, t, None, "s", None, *["x"] * 11) for i, t in pairs]
        return spark.createDataFrame(rows, DOC).repartition(slices)

    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long_text = " ".join(f"w{k % 997} and {k}" for k in range(20_000))
    return [
        (1, "plain words in a row that go on for a while here"),
        (1, "plain words in a row that go on for a while here"),
        (2, None),
        (3, ""),
        (4, "   \n\t "),
        (5, long_text),
        (None, "no id at all"),
        (None, None),
        (6, "plain words in a row that go on for a while here"),
        (7, "é ü ▁ \U0001f600 ①"),
    ]

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n", T.IntegerType()),
                     T.StructField("e", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("t", T.StringType()), T.StructField("label", T.StringType())])


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


PASSAGE = words(0, 60)
ROWS = [
    (1, PASSAGE, "b"), (2, PASSAGE + " more", "b"), (2, PASSAGE + " more", "b"),       # near copies, a repeated row
    (3, None, None), (4, "", "a"), (5, " \t\n ", "a"), (6, "one two", "a"), (7, "One TWO", "a"),
    (None, words(100, 170), None), (8, words(200, 230) + "\n" + PASSAGE + "\n" + words(300, 330), "c"),
    (9, words(1000, 40000), "c"), (10, "é ß 你好 \U0001F600 x", "d"), (11, words(100, 170), "d"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", None) for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

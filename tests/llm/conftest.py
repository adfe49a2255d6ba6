import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, ties, repeated rows, a long text and columns with clashing names."""
    long = "some quite long text with words. " * 4000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "the same words here again and again", "en", "s", 9), (4, "the same words here again and again", "en", "s", 9), (5, "the same words here again and again", "en", None, None), (6, long, "en", "s", len(long)), (None, "a text without an id", "fr", "s", 20), (7, "日本語のテキスト 😀 é", None, "s", 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "kept", "score", "length", "key", "node", "label", "bucket", "_row", "row", "group", "depth", "id", "v", "sample"):
        d = d.withColumn(name, F.lit("clash"))
    return d

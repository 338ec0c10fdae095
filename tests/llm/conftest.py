import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "en", "a"),
    (5, "one", "en", None),
    (6, "Tab\there  two  spaces \n\n and a\x0bline\x1cseparator nbsp  wide <|endoftext|> it's", "en", "a"),
    (7, LONG, "en", "c"),
    (8, "\U0001f600 emoji ñandú 漢字かな é 123 4567 ''' ... --- mixed!? a.b@c.de", "es", "a"),
    (None, "a row without an id", "en", "b"),
    (None, "a row without an id", None, "b"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today!", "en", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    for name in ("score", "fp", "size", "n_tokens", "_c", "part", "spans", "taken", "_tie", "target", "list", "y", "own"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

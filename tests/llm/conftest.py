import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with the names that operators use inside."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    rows = [(1, "The cat sat on the mat and then it went to the other house.", "en", "s", 5), (1, "The cat sat on the mat and then it went to the other house.", "en", "s", 5),
            (2, None, "en", "s", None), (3, "", None, None, 0), (None, "a b", "de", "s", 3), (4, long, "en", "s", 9), (5, " \n\t ", "en", "s", 4),
            (6, "12 34 !!", "fr", None, 8), (7, "x" * 3000, "en", "s", 1), (None, None, None, None, None), (8, "ab▁cd \x00 é 🙂\r\n\n  z", "de", "s", 2)]
    made = spark.createDataFrame(rows, SCHEMA)
    return made.withColumns({c: F.lit(7) for c in ("id", "n", "row", "tile", "label", "kind", "score", "shard", "_key", "word", "item", "digest", "first")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

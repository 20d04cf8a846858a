import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("size", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("Row", T.IntegerType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    shared = "this very line stands in many documents"
    texts = [None, "", " \t\n", "one", "three short words", long_text, long_text, "ÀÉ ñ 日本 é x y", "a\n\nb\n" + shared]
    texts += [shared + "\n" + " ".join(rng.choice(words) for _ in range(40)) for _ in range(14)]
    copy = " ".join(rng.choice(words) for _ in range(60))
    texts += [copy] * 5 + [copy.replace("w1 ", "w2 ", 1) + f" end{k}" for k in range(4)]
    rows = [(k, t, "en", f"s{k % 3}", 1, "x", 2, 0.5, 3, 4, "y", "n", "k") for k, t in enumerate(texts)]
    rows += [rows[5], rows[9], rows[9], (None, "no id", None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None, None, None), (9, "another text under nine", "en", None, 1, "x", 2, 0.5, 3, 4, "y", "n", "k")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, small_tables):
    return spark.read.parquet(f"{small_tables}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}

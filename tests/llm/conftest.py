import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, first=0, sources=("a", "b", None)):
        rows = [(first + i, t, "en", sources[i % len(sources)], len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text without an id", "en", "a", 20), (3, long, "en", "b", len(long)), (3, long, "en", "b", len(long)),
        (4, "same words here as there", "en", "a", 24), (5, "same words here as there", "fr", "a", 24), (6, " \n\t ", "en", None, 4), (7, "x", None, "b", 1), (8, "Été \U0001f600 " * 5, "fr", "c", 30),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 5, "k", 1.5, "t") for r in rows], DOCS + ", n int, key string, distance double, term string")
    return df.withColumn("shard", F.lit("old")).withColumn("id", F.lit(9)).withColumn("kind", F.lit("z"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

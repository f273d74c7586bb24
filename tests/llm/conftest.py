import pytest

ODD = [
    (90001, None),
    (90002, ""),
    (90003, " \n\t\x0b "),
    (None, "A null id with words, CC by MIT License a.b@c.de."),
    (90004, "Twice the same row here"),
    (90004, "Twice the same row here"),
    (90005, "x y " * 9000),
    (90006, "ein é ẞ 日本語 🙂 \x85 words"),
]


@pytest.fixture(scope="session")
def documents(spark, folder):
    """All documents of the smallest table, odd rows, and columns whose names clash with results."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    return docs.unionByName(odd).withColumns({"score": F.lit(1), "kept": F.lit("x"), "n_words": F.lit(2.0), "node": F.lit("y"), "start": F.lit(0)}).cache()


@pytest.fixture(scope="session")
def texts(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]

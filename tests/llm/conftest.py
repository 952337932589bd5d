import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, mix string, key string, kept string, _row string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns named like results."""
    long = "the sea and the land " * 6000
    texts = [None, "", " \t\n ", "Hello", "Hello", "12345 !!", long, "the cat sat on the mat in the house", "le chat est sur la table de la maison", "é", "x"]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[7], (None, "no key here at all", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def small_docs(spark):
    """Real rows with copies and shared passages, and what pandas has of them."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, df.toPandas()

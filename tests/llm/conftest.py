import zlib

import pytest


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="session")
def small():
    """The smallest documents as dicts."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents: nulls, empty and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} of the long text" for i in range(20_000))
    plain = " ".join(f"some plain words number {i} in a row" for i in range(12))
    rows = [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, None, "en", None, 1), (4, "", None, "a", 1), (5, " \t\n ", "en", "b", 1), (6, long, "en", "b", 1),
        (7, "short", "en", "b", 1), (7, "short", "en", "b", 1), (None, plain, None, None, 1), (None, None, None, None, 1), (8, plain + " and one more", "de", "c", 1), (9, "日本語 😀 ÉÀ", "de", "c", 1),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, kind)
    return df.selectExpr("*", "'x' AS id", "1 AS size", "2 AS node", "3 AS kept", "4 AS row", "5 AS target", "6 AS word", "7 AS n", "8 AS h", "9 AS mix", "10 AS score", "'a' AS __text", "'b' AS __id", "'c' AS __hash", "'d' AS __language", "'e' AS __node", "'f' AS __kept", "11 AS __size", "'g' AS own", "'h' AS doc")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


def crc(text):
    return zlib.crc32(str(text).encode())

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, fp string, row string, piece string"
LONG = "lorem ipsum dolor " * 20_000 + "x" * 50_000
PASSAGE = " ".join(f"word{k}" for k in range(30))

#: NULLs in every column, empty, blank and very long texts, ties, repeated rows; columns named like results.
EDGES = [
    (1, "One two three four. " + PASSAGE, "en", "a", 10, "x", "x", "x", "x", "x"),
    (1, "One two three four. " + PASSAGE, "en", "a", 10, "x", "x", "x", "x", "x"),
    (1, "another text with the same id", None, None, None, None, None, None, None, None),
    (2, None, "en", "a", None, "x", None, "x", "x", "x"),
    (3, "", "de", None, 0, "x", "x", "x", "x", "x"),
    (4, " \t\n\r\x0b\x0c ", None, "a", 7, "x", "x", "x", "x", "x"),
    (None, "a text without id " + PASSAGE, "en", "b", 9, "x", "x", "x", "x", "x"),
    (None, None, None, None, None, None, None, None, None, None),
    (5, LONG, "fr", "b", len(LONG), "x", "x", "x", "x", "x"),
    (6, "ÄÖÜ naïve 漢字 \U0001f600 é \x1c\x85", "de", "b", 9, "x", "x", "x", "x", "x"),
    (7, "mail a.b@c.de +49 (30) 12345678 or 4111 1111 1111 1111; 10.0.0.255 <|endoftext|>", "en", "b", 9, "x", "x", "x", "x", "x"),
    (9, "one", "en", "b", 9, "x", "x", "x", "x", "x"),
    (8, "one", "en", "b", 9, "x", "x", "x", "x", "x"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """Documents at sf0.001 in two partitions, and the folder that they come from."""
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(2, "doc_id"), sf


@pytest.fixture(scope="session")
def texts():
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
    return dict(rows)

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, h int, at string, n int, salt string, last string, shard int, anchor string, score string"


def rows_of(texts, start=0):
    """Rows with columns that clash with the operators' own names."""
    return [(start + i, t, "en", "s", 0, "x", "y", 1, "z", 2, "w", "v", 3, "u", "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, start=0: spark.createDataFrame(rows_of(texts, start), SCHEMA)


@pytest.fixture(scope="session")
def from_rows(spark):
    """(doc_id, text) rows, with the other columns filled."""
    return lambda rows: spark.createDataFrame([(i, t, *rows_of([t])[0][2:]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def sample():
    """Whole texts of a few hundred documents of the driver's table."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return [(i, x) for i, x in zip(t["doc_id"], t["text"])]


ODD = [None, "", " ", "\n\n", "a", "A", "Ünïcode ÄÖ 漢字 😀", "word " * 40_000, "same text here now", "Same Text HERE now", "same text here now ", "x\ty\x0bz", "퟿\u0000 nul", "tail"]


@pytest.fixture(scope="session")
def odd():
    return ODD

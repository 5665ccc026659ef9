import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHES = ("doc", "words", "n_words", "kept", "rid", "node", "key", "band", "base", "spans", "epoch", "domain", "wh", "lines", "signature", "score", "piece_ids", "n_tokens", "metric")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = " ".join(f"word{i} of{i % 7}" for i in range(40))


def edge_rows():
    return [
        (1, None, "en", "s1", 0),
        (2, "", "en", "s1", 0),
        (3, " \n\t ", None, None, 4),
        (None, PROSE, None, "s1", 9),
        (5, PROSE, "en", None, 9),
        (5, PROSE, "en", None, 9),
        (6, PROSE + " tail", "de", "s1", None),
        (7, LONG, "en", "s2", len(LONG)),
        (8, "x" * 50_000, "en", "s2", 50_000),
        (9, "one two", "fr", "s2", 7),
        (10, "a@b.example.com 10.1.2.3, 4111 1111 1111 1111 +49 151 2345678 é😀", "fr", "s3", 60),
        (5, "another text of the same id", "en", "s1", 27),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit("z") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

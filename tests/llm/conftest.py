import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, ties, repeated rows, odd characters, and a long text.
EDGE = [
    (1, "the cat sat on the mat and the dog lay by the door " * 8, "en", "a", 5), (1, "the cat sat on the mat and the dog lay by the door " * 8, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n ", "de", "b", 4), (None, "le chat est sur la table et le chien dort " * 9, "fr", None, 1),
    (5, "  é" * 3, "fr", "b", 9), (6, "!!! ### $$$", "xx", "", 1), (7, "word " * 30_000, "en", "b", 150_000), (8, "der Hund und die Katze sind im Haus und im Garten " * 7, "de", "c", 7), (9, "mail bob@x.org or +1 (555) 123-4567 now 4111 1111 1111 1111", "en", "c", 7),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCUMENTS)


@pytest.fixture(scope="session")
def odd(edge):
    """Further columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("fp", "key", "bucket", "size", "body", "log_weight", "gumbel_key", "copies", "positions", "turn", "row", "id", "due", "n_words", "items", "spans", "_kept_id", "target", "quality", "rule"))])


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (8, 1, None), (6, 0, 0), (7, 0, 1), (None, 1, 0), (9, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog lay by the door"), (2, "chien dort"), (3, None), (4, " .. "), (1, "chien dort")], "item_id long, text string")

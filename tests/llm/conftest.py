from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(40_000))
COPY = "the quick brown fox jumps over the lazy dog and then it runs far away from here " * 4
#: doc_id, text, lang, source, n_chars: nulls in every column, empty and long texts, ties and repeated rows
EDGE = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "   \t\n ", None, None, 5),
    (4, "one two", "en", "b", 7),
    (5, "One two", "de", "b", 7),
    (6, COPY, "en", "a", len(COPY)),
    (7, COPY, "en", "b", len(COPY)),
    (8, COPY + "end", "en", None, 1),
    (8, COPY + "end", "en", None, 1),
    (9, LONG, "en", "a", len(LONG)),
    (None, "no id at all but some words", "en", "a", 3),
    (None, None, None, None, None),
    (10, "mail bob.smith@example.org or +44 (0)20 7946-0958, ip 10.0.0.1 and 300.1.1.1", "en", "c", 9),
    (11, "card 4111 1111 1111 1111 bad 4111 1111 1111 1112 a@b@c.de x@y", "en", "c", 9),
    (12, "über 中文 \U0001f600 mail: j@ü.de k@l-m.n.op", "zh", "c", 9),
    (13, "a a a a a a a a a a a a a a a", "en", "c", 9),
    (14, "x" * 700, "en", "c", 700),
]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


@pytest.fixture(scope="session")
def edge(spark):
    """Hostile rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS k", "'x' AS t", "2 AS size", "3 AS node", "4 AS below", "5 AS whole", "6 AS source_size", "7 AS digest", "8 AS row").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def more_docs(spark, middle):
    return spark.read.parquet(f"{middle}/documents.parquet")

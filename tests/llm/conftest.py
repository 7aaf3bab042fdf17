import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000)) + "\n"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows and ids."""
    return [
        (1, "The first line of it\nshared line of text\nshort", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n \r\n", "de", "b"),
        (5, LONG, "en", "a"),
        (6, "The first line of it\nshared line of text\nshort", "en", "a"),
        (6, "The first line of it\nshared line of text\nshort", "en", "a"),
        (7, "SHARED LINE OF TEXT  \nown line of seven here", None, "a"),
        (None, "shared line of text\nno id here at all", "en", None),
        (8, "Écriture é unie à l'été, mail x.y@site.example.org now", "fr", "b"),
        (8, "another text with the same id", "fr", "b"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    extra = ("n", "hi", "lo", "key", "block", "row", "topic", "kept", "weight", "item_id", "component_id", "_gone", "part")
    return df.selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in extra]).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

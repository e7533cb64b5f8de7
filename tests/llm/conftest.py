"""Small corpora with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from llm_texts import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that every operator has to survive."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [
        (1, base, "en", "a", None),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "   \n\t ", "de", "b", 6),
        (5, base, "en", "a", None),
        (5, base, "en", "a", None),
        (None, base, "en", None, None),
        (None, None, None, None, None),
        (6, words(rng, 30000), "fr", "b", None),
        (7, "x" * 200_000, "fr", "b", None),
        (8, base + " " + words(rng, 60), "en", "c", None),
        (9, "É" * 60 + "\x00\x01" + "🙂" * 40, "es", "c", None),
        (9, "other text of the same id " * 4, "es", "c", None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """Extra columns named as things that operators add."""
    from pyspark.sql import functions as F

    names = "fp g h m w p s e x key k row rid node root items runs score epoch tokens budget blob digest shard offset length _id _key _lang quality y host path kind range"
    return awkward.select("*", *[F.lit(7).alias(n) for n in names.split()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def folder(spark):
    from gridloom.llm.common import shared_dir

    return shared_dir(spark)

"""Small documents with the awkward cases every operator must take."""

import random

import pytest
from flaskmill.llm.queries import ship
from pyspark.sql import functions as F
from rows_of import prose



@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """Workers find the package wherever the tests are started."""
    ship(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty, blank and long texts, copies, near copies, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(12)]
    shared = prose(rng, 120)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20 + i, base[0], "en", "s0", len(base[0])) for i in range(4)]  # copies
    rows += [(30 + i, base[1] + f" tail{i}", "fr", "s1", 1) for i in range(5)]  # near copies
    rows += [(40 + i, prose(rng, 70) + "\n" + shared + "\n" + prose(rng, 70), "de", None, 1) for i in range(4)]
    rows += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, " \n\t ", "en", "s0", 4)]
    rows += [(53, "one two", "en", "s2", 7), (54, "one two", "en", "s2", 7), (55, "é\u2028x", "fr", "s2", 3)]
    rows += [(56, "for " * 400, "en", "s1", 1600), (57, prose(rng, 6000), "en", "s1", 1)]
    rows += [(None, base[2], "en", "s1", 1), (None, None, None, None, None)]
    rows += [(3, base[3], "en", "s0", len(base[3]))] * 2  # a row three times, by id and text
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns with the names that operators use for their own."""
    names = ["score", "k1", "k2", "size", "at", "tie", "shard", "quota", "node", "root", "h", "c", "digest", "line_no"]
    return awkward.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from flaskmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column over a single row of named literals."""

    def value(column, **literals):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, v in literals.items():
            row = row.withColumn(name, v if hasattr(v, "_jc") else F.lit(v))
        return row.select(column.alias("v")).head()["v"]

    return value

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from placesearch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def one(spark):
    """Value of a Column function over one string."""
    from pyspark.sql import functions as F

    def run(rule, text, kind="string"):
        df = spark.createDataFrame([(text,)], f"t {kind}")
        return df.select(rule(F.col("t")).alias("r")).first().r
    return run

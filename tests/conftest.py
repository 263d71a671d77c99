import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "plumbline-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """Four rows with gaps in a number and a text."""
    return spark.createDataFrame([(1.0, "x", 0), (2.0, "y", 1), (None, "x", 0), (4.0, None, 1)], "a double, b string, target long")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]

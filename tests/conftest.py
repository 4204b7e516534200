import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from placegrid.session import build_session

    session = build_session("tests", 8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows from dicts or tuples with a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)

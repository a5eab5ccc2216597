import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fixtures.compare import connect, session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples in column order."""

    def take(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return take

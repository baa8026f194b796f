import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from txnrisk.session import local_session

    session = local_session(cpus="8", shuffle_partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a list of dicts, ordered by the given columns."""

    def collect(df, *order):
        return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

    return collect

import datetime as dt

import pytest

from paperloom.testing import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def day():
    """Day n of a fixed month."""
    return lambda n: dt.datetime(2024, 3, n)

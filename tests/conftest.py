import os

import pytest

from foldmark.session import get_spark

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark(os.environ.get("TEST_CPUS", "8"), "foldmark-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return TINY

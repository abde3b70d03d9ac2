import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelloom.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "labelloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are not mounted")
    return path

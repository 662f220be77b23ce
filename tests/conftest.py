import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from engramlake.session import local_session, ship

    session = local_session("8", "6g", "tests")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL

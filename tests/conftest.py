import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from headcount.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="headcount-tests")
    yield session
    release(session)
    session.stop()

import pytest

from larder.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "larder-tests", "6g")
    yield session
    session.stop()

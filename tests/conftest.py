import pytest

from punctua.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

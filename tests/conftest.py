import pytest

from flowtide.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[8]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

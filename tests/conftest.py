import pytest

from tidemark.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=2)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF

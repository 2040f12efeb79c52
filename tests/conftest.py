import pytest

from examforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", memory="6g", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])

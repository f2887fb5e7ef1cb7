import pytest

from strandframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples of the named columns."""

    def get(df, *cols):
        return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)

    return get

import pytest

from petrigrid.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[8]", 4)

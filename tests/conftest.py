import pytest

from crosstide.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, 4)

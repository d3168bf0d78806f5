import pytest

from rankatlas.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, 4, "4g")

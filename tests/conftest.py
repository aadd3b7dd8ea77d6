import pytest

from loomspark.session import session


@pytest.fixture(scope="session")
def spark():
    made = session(4, 4, "4g")
    made.sparkContext.setLogLevel("ERROR")
    return made

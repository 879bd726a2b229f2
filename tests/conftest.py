import duckdb
import pytest

from larder.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", partitions=4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def duck():
    with duckdb.connect() as connection:
        connection.execute("SET TimeZone='UTC'")
        yield connection

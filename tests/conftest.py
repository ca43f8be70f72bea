import pytest

from mapweave.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

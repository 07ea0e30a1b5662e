import pytest

from lodestrata.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, memory="3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

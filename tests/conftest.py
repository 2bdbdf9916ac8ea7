import pytest

from sparkloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4", 4, "3g")
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('steps')}")
    ship_package(session)
    yield session
    session.stop()

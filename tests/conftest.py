import pytest

from talkloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, driver_memory="4g")
    ship_package(session)
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"

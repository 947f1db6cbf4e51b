import pytest

from panelwright.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "panelwright-tests", master="local[8]", shuffle_partitions=8, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session

import pytest

from tallyloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, spark_ui_showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

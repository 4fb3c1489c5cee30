import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from wardline.session import local_session

    session = local_session(cores=8, app="wardline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tabsight.session import local_session

    session = local_session()
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabsight-test-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    from compare import SF

    return SF

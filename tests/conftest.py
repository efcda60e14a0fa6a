import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from wayloom.session import local_session

    session = local_session(8, "wayloom-tests")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session
    session.stop()

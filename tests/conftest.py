import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from failscope.session import local_session

    session = local_session(8, shuffle_partitions=4)
    yield session
    from failscope.storage import release

    release(session)
    session.stop()

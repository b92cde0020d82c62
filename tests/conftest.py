import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from engram.session import local_session
    return local_session(cpus=4, partitions=4, memory="4g")

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lonja.session import get_session

    s = get_session("tests", cpus="4", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL

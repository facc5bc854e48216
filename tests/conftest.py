import os
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HOME)


@pytest.fixture(scope="session")
def spark():
    from modwarden.session import prepare, session

    s = prepare(session("tests", cpus=4, shuffle_partitions=4))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

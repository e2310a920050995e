import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskpanel.session import local_session

    return local_session("8", partitions=4)
import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

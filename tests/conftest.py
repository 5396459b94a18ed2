import os
import sys

import pytest

# Test modules import constants and helpers from compare.py: with several conftest files, "conftest" names only one of them.
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from merchlens.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="merchlens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck_oracle():
    from compare import SF_ORACLE, duck
    return duck(SF_ORACLE)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skywatch.session import get_spark
    s = get_spark("local[*]", 8, app_name="skywatch-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL

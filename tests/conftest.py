import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skein.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, spark__driver__memory="4g")


@pytest.fixture(scope="session")
def data():
    return os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")

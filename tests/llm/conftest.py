import pytest


@pytest.fixture(scope="session")
def sf(data):
    return data

import pytest
from conftest import SF_DIR


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR

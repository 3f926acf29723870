import hashlib

import pytest


@pytest.fixture(scope="session")
def sha():
    return lambda s: hashlib.sha256(s.encode()).hexdigest()

import os
import sys

import pytest

os.environ["TZ"] = "UTC"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build

    yield build(8, 4, "4g")

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from affinia.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=4, name="tests")


@pytest.fixture
def tiny_buckets(monkeypatch):
    """Cut ordered groups into many slices, as hot groups are."""
    from affinia.operators import scale

    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 3)

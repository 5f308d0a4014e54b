import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from strandline.operators.hot import HOT_ROWS_CONF  # noqa: E402
from strandline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def split_groups(spark):
    """Treat any group above an average partition as hot, so small fixtures take the split plans."""
    spark.conf.set(HOT_ROWS_CONF, "1")
    yield
    spark.conf.unset(HOT_ROWS_CONF)

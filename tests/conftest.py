import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def split_small(spark):
    """Make every group too long for one task, so that the split plans run."""
    spark.conf.set("barloom.rows.per.task", "7")
    yield
    spark.conf.unset("barloom.rows.per.task")

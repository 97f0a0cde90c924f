import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("flowspark-tests", cpus="8")
    yield session
    session.stop()


@pytest.fixture
def force_hot(spark):
    """Treat every key with three rows as hot, in few slices."""
    spark.conf.set("spark.flowspark.hotMinRows", "3")
    spark.conf.set("spark.flowspark.hotSlices", "4")
    yield
    spark.conf.unset("spark.flowspark.hotMinRows")
    spark.conf.unset("spark.flowspark.hotSlices")

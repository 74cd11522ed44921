import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = spark_session()
    s.conf.set("spark.sql.shuffle.partitions", "2")
    yield s
    s.stop()

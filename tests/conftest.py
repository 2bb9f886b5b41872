import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from matchspark.session import local_session
    s = local_session("*", app="matchspark-tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
    s.stop()

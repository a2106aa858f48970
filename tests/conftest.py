import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpuslens.session import get_spark
    s = get_spark(app="corpuslens-tests", master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def planned(spark):
    """Every registered query, built once on the smallest tables."""
    import __spark_entry__ as E
    return {name: fn(spark, SMOKE) for name, fn in E.queries().items()}

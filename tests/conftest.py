import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from montevar.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def built_queries(spark):
    """Each registered query built once on sf0.001 and shared by the plan and oracle tests."""
    from montevar.plans.catalog import queries
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = queries()[name](spark, SF_SMALL)
        return cache[name]

    return get

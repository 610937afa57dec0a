import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkseries.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8)
    yield s


def hourly(n, start=datetime(2024, 1, 1)):
    return [start + timedelta(hours=i) for i in range(n)]


def rows_of(df, *cols):
    """Rows sorted by the given columns, as tuples."""
    return [tuple(r) for r in df.orderBy(*cols).select(*cols).collect()]


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))

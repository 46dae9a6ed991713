import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slidecast.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"
EPOCH = dt.datetime(1970, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", shuffle_partitions=4)
    yield s


def at(seconds: float) -> dt.datetime:
    """A naive timestamp ``seconds`` after the epoch (fixtures count from 0)."""
    return EPOCH + dt.timedelta(seconds=seconds)


def secs(t: dt.datetime) -> float:
    return (t - EPOCH).total_seconds()


@pytest.fixture
def events_of(spark):
    """Build a tiny events-shaped table from (ts_seconds, user, type, value) tuples."""
    def make(rows):
        data = [(i, at(t), u, ty, float(v), '{"k": %d}' % i) for i, (t, u, ty, v) in enumerate(rows)]
        return spark.createDataFrame(
            data, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
    return make

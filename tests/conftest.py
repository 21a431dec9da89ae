import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.operators.bars import BAR_SCHEMA  # noqa: E402
from tickloom.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4)


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars of one key on consecutive weekdays from a list of closes."""
    def make(closes, key="A", spread=1.0, volume=None, start=dt.date(2024, 1, 1)):
        rows, day = [], start
        for i, c in enumerate(closes):
            while day.weekday() > 4:
                day += dt.timedelta(1)
            rows.append((key, day, float(c), c + spread, c - spread, float(c),
                         int(volume[i]) if volume is not None else 1000 + 10 * i))
            day += dt.timedelta(1)
        return spark.createDataFrame(rows, BAR_SCHEMA)
    return make


@pytest.fixture(scope="session")
def walk():
    import numpy as np
    rng = np.random.default_rng(42)
    return (100 + np.cumsum(rng.normal(0, 1, 330))).tolist()

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def bars_of(spark):
    """Bars from (open, high, low, close) tuples on a clock of 1000 ms."""

    def make(rows, step=1000, tf="1h"):
        data = [("X", tf, i, i * step, i * step + step - 1, i * step + step, float(o), float(h), float(l), float(c)) for i, (o, h, l, c) in enumerate(rows)]
        return spark.createDataFrame(data, "symbol string, tf string, idx long, open_time long, close_time long, end long, open double, high double, low double, close double")

    return make

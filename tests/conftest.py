import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from buywave.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        4,
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n, hour=12, minute=0):
    """Timestamp on the n-th day counted from 2024-03-01."""
    return dt.datetime(2024, 3, 1, hour, minute) + dt.timedelta(days=n)


EVENT_SCHEMA = (
    "event_id string, event_type string, ts timestamp_ntz, session_id string, user_id string, "
    "region string, item_id string, price double, properties string"
)


@pytest.fixture
def make_events(spark):
    """Events from (user, type, ts, price, item) rows; ids follow the row order."""
    from buywave.operators.events import normalize_loaded

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            user, kind, ts, price, item = (*row, None, None)[:5]
            item = "" if item is None else item
            full.append((f"e{i:05d}", kind, ts, "s", user, "UA-30", item, price, "{}"))
        return normalize_loaded(spark.createDataFrame(full, EVENT_SCHEMA))

    return make

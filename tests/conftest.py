import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from sentrylake.session import build_session  # noqa: E402

EVENT_SCHEMA = (
    "event_id bigint, event_type string, timestamp bigint, user string, source_user string, destination_user string, "
    "source_host string, destination_host string, process string, action string, details string, bytes bigint, "
    "duration bigint, is_redteam int"
)
EVENT_NAMES = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; absent fields are null and ids count up."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            d = {"event_id": i, "is_redteam": 0, **r}
            full.append(tuple(d.get(n) for n in EVENT_NAMES))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make

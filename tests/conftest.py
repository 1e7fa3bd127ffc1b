import json
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketflow.plans.session import build_session  # noqa: E402
from basketflow.schema import EVENT_SCHEMA  # noqa: E402
from basketflow.sources import with_event_time  # noqa: E402

DAY = "2025-01-01T"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "basketflow-tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.maxMetadataStringLength": "1000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def stamp(clock: str) -> datetime:
    """``HH:MM:SS[.ffffff]`` on the test day, in UTC."""
    return datetime.fromisoformat(DAY + clock).replace(tzinfo=timezone.utc)


def naive(clock: str) -> datetime:
    """The same as a timestamp comes back when the process runs in UTC."""
    return datetime.fromisoformat(DAY + clock)


def event(clock="00:00:00", kind="view", user=1, product=1, category="Toys", price=1.0, city="Quito"):
    return {
        "user_id": user,
        "product_id": product,
        "category": category,
        "event_type": kind,
        "price": price,
        "timestamp": None if clock is None else stamp(clock),
        "city": city,
    }


@pytest.fixture
def make_events(spark):
    def make(*rows):
        columns = [[row.get(name) for name in EVENT_SCHEMA.names] for row in rows]
        return with_event_time(spark.createDataFrame(columns, EVENT_SCHEMA))

    return make


@pytest.fixture
def drop_files(tmp_path):
    """Write lists of events as JSON-lines files whose times ascend; returns the folder."""
    folder = tmp_path / "incoming"
    folder.mkdir()
    written = []

    def drop(*batches):
        for batch in batches:
            path = folder / f"part-{len(written):03d}.json"
            lines = []
            for row in batch:
                if isinstance(row, dict):
                    moment = row["timestamp"]
                    text = None if moment is None else moment.isoformat().replace("+00:00", "Z")
                    row = json.dumps(row | {"timestamp": text})
                lines.append(row)
            path.write_text("\n".join(lines) + "\n")
            moment = 1_700_000_000 + 10 * len(written)
            os.utime(path, (moment, moment))
            written.append(path)
        return str(folder)

    return drop


def rows(frame, *names):
    """The rows as a sorted list of tuples."""
    chosen = frame.select(*names) if names else frame
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple(map(str, r)))

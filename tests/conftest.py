from __future__ import annotations

import sys
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from paceline.session import build_session  # noqa: E402

LOG = "user_id bigint, event string, ts timestamp_ntz"
USERS = "user_id bigint, plan string, country string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_table(spark, tmp_path_factory):
    """Rows written as a parquet file and read back."""
    folder = tmp_path_factory.mktemp("tables")

    def build(columns: dict[str, pa.Array], schema: str):
        path = str(folder / f"{uuid.uuid4().hex}.parquet")
        pq.write_table(pa.table(columns), path)
        return spark.read.schema(schema).parquet(path)

    return build


@pytest.fixture(scope="session")
def make_log(make_table):
    """A log from (user, event, time) rows; a number is days after 2024-01-01."""

    def build(rows):
        users, events, times = zip(*rows, strict=True)
        stamps = [t if isinstance(t, datetime) else datetime(2024, 1, 1) + timedelta(days=t) for t in times]
        columns = {
            "user_id": pa.array(users, pa.int64()),
            "event": pa.array(events, pa.string()),
            "ts": pa.array(stamps, pa.timestamp("us")),
        }
        return make_table(columns, LOG)

    return build


@pytest.fixture(scope="session")
def make_users(make_table):
    def build(rows):
        ids, plans, countries = zip(*rows, strict=True)
        columns = {
            "user_id": pa.array(ids, pa.int64()),
            "plan": pa.array(plans, pa.string()),
            "country": pa.array(countries, pa.string()),
        }
        return make_table(columns, USERS)

    return build

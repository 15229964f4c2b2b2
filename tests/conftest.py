from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from freightlens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    return SMALL


READING = "id bigint, asset_id string, ts timestamp_ntz, shipment_status string, traffic_status string, waiting_time int, logistics_delay boolean, logistics_delay_reason string, delay_probability double, latitude double, longitude double, is_active boolean"


@pytest.fixture
def readings(spark):
    """Build readings from short rows: (day offset, hour, delayed, extra fields)."""

    def build(rows):
        full = []
        for i, (day, hour, delayed, extra) in enumerate(rows):
            row = {
                "id": i, "asset_id": "Truck_1", "ts": dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour),
                "shipment_status": "Delayed" if delayed else "In Transit", "traffic_status": "Clear", "waiting_time": 10,
                "logistics_delay": delayed, "logistics_delay_reason": "Weather" if delayed else "None",
                "delay_probability": 0.5, "latitude": 1.0, "longitude": 2.0, "is_active": True,
            }
            row.update(extra)
            full.append(tuple(row[c.split()[0]] for c in READING.split(", ")))
        return spark.createDataFrame(full, READING)

    return build

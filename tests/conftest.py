"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.executorEnv.PYTHONPATH", ROOT).config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    yield session
    session.stop()


KINDS = {
    "id": T.LongType(), "ts": T.TimestampNTZType(), "lat": T.DoubleType(), "lon": T.DoubleType(), "value": T.DoubleType(),
    "kind": T.StringType(), "user": T.LongType(),
}
START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def make(spark):
    """A frame from rows given as dicts; missing columns are filled in."""
    from chronomesh.frame import EventFrame
    from chronomesh.schema import EventMetadata, EventSchema

    def build(rows, **extra):
        kinds = {**KINDS, **extra}
        full = []
        for i, r in enumerate(rows):
            r = {"id": i, "ts": START + timedelta(hours=i), "lat": 41.8 + i * 0.001, "lon": -87.6, "value": float(i), "kind": "AB"[i % 2], "user": i % 2, **r}
            full.append(tuple(r.get(c) for c in kinds))
        df = spark.createDataFrame(full, T.StructType([T.StructField(c, t) for c, t in kinds.items()]))
        schema = EventSchema(timestamp_col="ts", lat_col="lat", lon_col="lon", id_col="id", categorical_cols=["kind"], numeric_cols=["value"])
        return EventFrame(df, schema, EventMetadata(dataset_name="test"))

    return build


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a frame as dicts in the order of ids."""

    def get(frame):
        return sorted((r.asDict() for r in frame.df.collect()), key=lambda r: r["id"])

    return get

"""The city crime dataset: reading, cleaning, sampling, roles."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.schema import DatasetConfig, EventMetadata, EventSchema

#: Roles of the dataset's columns.
CRIME_SCHEMA = EventSchema(
    timestamp_col="date", lat_col="latitude", lon_col="longitude",
    categorical_cols=["primary_type", "description", "location_description", "arrest", "domestic", "beat", "district", "ward", "community_area", "fbi_code"],
    numeric_cols=["x_coordinate", "y_coordinate"],
)


def create_metadata(crs: str = "EPSG:4326", time_zone: str = "America/Chicago", **more: Any) -> EventMetadata:
    return EventMetadata(dataset_name="chicago_crime", crs=crs, time_zone=time_zone, **more)


def load_raw(raw_path: str, layout: str = "nested", spark: SparkSession | None = None) -> DataFrame:
    """Parquet files below a folder (nested) or in it (flat); CSV if the path ends so."""
    spark = spark or SparkSession.active()
    if layout not in ("nested", "flat"):
        raise ValueError(f"unknown layout: {layout}")
    if raw_path.endswith(".csv"):
        return spark.read.csv(raw_path, header=True, inferSchema=True)
    return spark.read.option("recursiveFileLookup", layout == "nested").parquet(raw_path)


def clean(df: DataFrame) -> DataFrame:
    """Dates parsed, rows without a place on earth dropped, arrest and domestic as booleans."""
    kinds = dict(df.dtypes)
    made = {}
    if kinds.get("date") == "string":
        made["date"] = F.try_to_timestamp("date", F.lit("MM/dd/yyyy hh:mm:ss a")).cast("timestamp_ntz")
    made |= {c: F.lower(c) == "true" for c in ("arrest", "domestic") if kinds.get(c) == "string"}
    return df.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)).withColumns(made)


def load_crime(raw_path: str | None = None, config: DatasetConfig | dict[str, Any] | None = None, apply_cleaning: bool = True) -> EventFrame:
    """The dataset as a frame; the config overrides path, layout, system and zone."""
    own = config if isinstance(config, DatasetConfig) else DatasetConfig(**(config or {}))
    path = own.raw_path or raw_path
    if not path:
        raise ValueError("a path is needed")
    df = load_raw(path, own.layout)
    return EventFrame(clean(df) if apply_cleaning else df, CRIME_SCHEMA, create_metadata(own.crs, own.time_zone))


def sample(event_frame: EventFrame, n: int | None = None, fraction: float | None = None, seed: int = 42) -> EventFrame:
    """Exactly n rows, those of the least hash of their values, or about a fraction; the same on every run.

    Rows of one hash are the same row but for a chance of one in 2 ** 64, so no
    other column is compared, and each task keeps its n best only.
    """
    df = event_frame.df
    if n is not None:
        return event_frame.with_df(df.orderBy(F.xxhash64(*df.columns, F.lit(seed))).limit(n))
    if fraction is None:
        raise ValueError("n or fraction is needed")
    return event_frame.with_df(df.sample(fraction=fraction, seed=seed))

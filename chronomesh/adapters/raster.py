"""Rasters for convolutional models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, ClassVar, Literal

import numpy as np
import pyarrow as pa
from pydantic import BaseModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.adapters.base import BaseModalityAdapter, Output
from chronomesh.frame import EventFrame
from chronomesh.registry import ADAPTERS

#: Cells of a raster that ``convert`` fills at most.
MAX_CELLS = 500_000_000


class RasterAdapterConfig(BaseModel):
    grid_col: str | None = None
    timestamp_col: str | None = None
    feature_cols: list[str] | None = None
    grid_shape: tuple[int, int] | None = None
    time_steps: int | None = None
    fill_value: float = 0.0
    normalize: bool = False
    channel_first: bool = True
    dtype: Literal["float32", "float64"] = "float32"


@dataclass
class RasterOutput(Output):
    raster: np.ndarray
    timestamps: list[Any] = field(default_factory=list)
    channel_names: list[str] = field(default_factory=list)
    grid_shape: tuple[int, int] = (0, 0)
    channel_first: bool = True
    dtypes: dict[str, str] = field(default_factory=dict)
    array_fields: ClassVar[tuple[str, ...]] = ("raster",)

    def __post_init__(self) -> None:
        self.grid_shape = tuple(self.grid_shape)

    @property
    def n_timesteps(self) -> int:
        return self.raster.shape[0]

    @property
    def n_channels(self) -> int:
        return self.raster.shape[1 if self.channel_first else 3]

    @property
    def height(self) -> int:
        return self.grid_shape[0]

    @property
    def width(self) -> int:
        return self.grid_shape[1]

    def to_tensorflow(self) -> np.ndarray:
        """Time, height, width, channel."""
        return np.transpose(self.raster, (0, 2, 3, 1)) if self.channel_first else self.raster


@ADAPTERS.decorator("raster", tags={"raster", "cnn", "image"}, config_model=RasterAdapterConfig)
class RasterAdapter(BaseModalityAdapter):
    """A picture a timestamp; the last row of a cell and time wins, cells outside the grid are left out."""

    config_class, output_class, modality, formats = RasterAdapterConfig, RasterOutput, "raster", ("arrow",)

    def cell(self, source: EventFrame | DataFrame) -> str:
        columns = self.data(source).columns
        found = next((c for c in (self.config.grid_col, "grid_id", "cell_id") if c and c in columns), None)
        if found is None:
            raise ValueError("no grid column")
        return found

    def shape(self, source: EventFrame | DataFrame) -> tuple[tuple[int, int], bool]:
        """Rows and columns, and whether cells are named ``row_column``."""
        df, cell = self.data(source), F.col(self.cell(source)).cast("string")
        part = lambda k: F.regexp_extract(cell, r"^(\d+)_(\d+)$", k).try_cast("int")
        n, named, rows, cols = df.where(cell.isNotNull()).agg(F.countDistinct(cell), F.coalesce(F.bool_and(cell.rlike(r"^\d+_\d+$")), F.lit(False)), F.max(part(1)), F.max(part(2))).first()
        if self.config.grid_shape:
            return self.config.grid_shape, named
        side = math.ceil(math.sqrt(n))
        return ((rows + 1, cols + 1) if named else (side, side)), named

    def frame(self, source: EventFrame | DataFrame) -> DataFrame:
        """Long form of the cells that have rows: t, row, col, time and a column a channel."""
        (h, w), named = self.shape(source)
        cell, ts, df = self.cell(source), self.timestamp(source), self.data(source)
        names = self.features(source, self.config.feature_cols, cell)
        # ranks over distinct times and cells: one row each
        times = df.where(F.col(ts).isNotNull()).select(F.col(ts).alias("_time")).distinct().withColumn("t", F.row_number().over(Window.orderBy("_time")) - 1)
        if self.config.time_steps:
            times = times.where(F.col("t") < self.config.time_steps)
        if named:
            parts = F.split(F.col("_cell"), "_")
            places = df.where(F.col(cell).isNotNull()).select(F.col(cell).cast("string").alias("_cell")).distinct().select("_cell", parts[0].cast("int").alias("row"), parts[1].cast("int").alias("col"))
        else:
            ids = df.where(F.col(cell).isNotNull()).select(F.col(cell).alias("_id")).distinct().withColumn("_i", F.row_number().over(Window.orderBy("_id")) - 1)
            places = ids.select(F.col("_id").cast("string").alias("_cell"), F.floor(F.col("_i") / w).cast("int").alias("row"), (F.col("_i") % w).cast("int").alias("col"))
        places = places.where((F.col("row") < h) & (F.col("col") < w))
        order = F.struct(*self.order(source), *(self.numeric(c) for c in names)) if names else F.struct(*self.order(source))
        last = df.groupBy(F.col(ts).alias("_ts"), F.col(cell).cast("string").alias("_c")).agg(*(F.max_by(self.numeric(c), order).alias(c) for c in names))
        joined = last.join(times, F.col("_ts") == F.col("_time")).join(places, F.col("_c") == F.col("_cell"))
        out = joined.select("t", "row", "col", F.col("_time").alias("time"), *(F.coalesce(F.col(f"`{c}`"), F.lit(float(self.config.fill_value))).alias(c) for c in names))
        if self.config.normalize:
            stats = out.agg(*(x for i, c in enumerate(names) for x in (F.avg(f"`{c}`").alias(f"_m{i}"), F.stddev_pop(f"`{c}`").alias(f"_s{i}"))))
            scaled = [((F.col(f"`{c}`") - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))).alias(c) for i, c in enumerate(names)]
            out = out.join(F.broadcast(stats)).select("t", "row", "col", "time", *scaled)  # one row
        return out

    def convert(self, event_frame: EventFrame | DataFrame) -> RasterOutput:
        (h, w), _ = self.shape(event_frame)
        table = self.gather(self.frame(event_frame))
        names, ts = table.column_names[4:], self.timestamp(event_frame)
        times = self.data(event_frame).where(F.col(ts).isNotNull()).select(ts).distinct().orderBy(ts)
        stamps = [r[0] for r in (times.limit(self.config.time_steps) if self.config.time_steps else times).collect()]
        if len(stamps) * h * w * max(1, len(names)) > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} cells; use the DataFrame form")
        out = np.full((len(stamps), len(names), h, w), self.config.fill_value, self.dtype)
        at = [table[c].to_numpy() for c in ("t", "row", "col")]
        for k, name in enumerate(names):
            out[at[0], k, at[1], at[2]] = table[name].to_numpy()
        if not self.config.channel_first:
            out = np.transpose(out, (0, 2, 3, 1))
        return RasterOutput(out, stamps, names, (h, w), self.config.channel_first, {"raster": self.dtype})

    def to_table(self, output: RasterOutput) -> pa.Table:
        x = output.raster if output.channel_first else np.transpose(output.raster, (0, 3, 1, 2))
        t, _, h, w = x.shape
        index = np.indices((t, h, w)).reshape(3, -1)
        return pa.table(dict(zip(("t", "row", "col"), index)) | {c: x[:, k].ravel() for k, c in enumerate(output.channel_names)})

    def from_table(self, table: pa.Table, plain: dict[str, Any]) -> RasterOutput:
        h, w = plain["grid_shape"]
        t = table.num_rows // max(1, h * w)
        x = np.stack([table[c].to_numpy().reshape(t, h, w) for c in plain["channel_names"]], axis=1) if plain["channel_names"] else np.zeros((t, 0, h, w))
        return RasterOutput(x if plain["channel_first"] else np.transpose(x, (0, 2, 3, 1)), **plain)

"""Padded sequences for recurrent and attention models."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar, Literal

import numpy as np
import pyarrow as pa
from pydantic import BaseModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.adapters.base import BaseModalityAdapter, Output
from chronomesh.frame import EventFrame
from chronomesh.registry import ADAPTERS

#: Steps of a sequence in one row of the pieces.
PIECE = 1024


class SequenceAdapterConfig(BaseModel):
    spatial_col: str | None = None
    timestamp_col: str | None = None
    feature_cols: list[str] | None = None
    sequence_length: int | None = None
    padding_value: float = 0.0
    padding_side: Literal["left", "right"] = "right"
    time_encoding: Literal["none", "positional", "sinusoidal"] = "none"
    return_masks: bool = True
    dtype: Literal["float32", "float64"] = "float32"


@dataclass
class SequenceOutput(Output):
    sequences: np.ndarray
    masks: np.ndarray
    sequence_ids: list[Any] = field(default_factory=list)
    feature_names: list[str] = field(default_factory=list)
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    time_encoding: np.ndarray | None = None
    dtypes: dict[str, str] = field(default_factory=dict)
    array_fields: ClassVar[tuple[str, ...]] = ("sequences", "masks", "lengths", "time_encoding")

    @property
    def n_sequences(self) -> int:
        return self.sequences.shape[0]

    @property
    def max_length(self) -> int:
        return self.sequences.shape[1]

    @property
    def n_features(self) -> int:
        return self.sequences.shape[2]


@ADAPTERS.decorator("sequence", tags={"sequence", "rnn", "transformer"}, config_model=SequenceAdapterConfig)
class SequenceAdapter(BaseModalityAdapter):
    """One sequence a spatial unit, in order of time; longer ones keep their earliest rows, ``lengths`` are whole."""

    config_class, output_class, modality, formats = SequenceAdapterConfig, SequenceOutput, "sequence", ("arrow",)

    def unit(self, source: EventFrame | DataFrame) -> str:
        columns = self.data(source).columns
        found = next((c for c in (self.config.spatial_col, "grid_id", "zone_id", "cell_id") if c and c in columns), None)
        if found is None:
            raise ValueError("no column of spatial units")
        return found

    def frame(self, source: EventFrame | DataFrame) -> DataFrame:
        """Long form: unit, position (from 0), length of the unit, features; cut to ``sequence_length``."""
        unit = self.unit(source)
        names = self.features(source, self.config.feature_cols, unit)
        per = Window.partitionBy(unit)
        rows = self.data(source).where(F.col(unit).isNotNull()).withColumns({"position": F.row_number().over(per.orderBy(*self.order(source))) - 1, "length": F.count("*").over(per)})
        if self.config.sequence_length:
            rows = rows.where(F.col("position") < self.config.sequence_length)
        return rows.select(F.col(unit).alias("unit"), "position", "length", *(F.coalesce(self.numeric(c), F.lit(0.0)).alias(c) for c in names))

    def arrays_frame(self, source: EventFrame | DataFrame) -> DataFrame:
        """A row a unit: unit, length, values (array of feature arrays in order), padded if ``sequence_length`` is set, and mask."""
        long = self.frame(source)
        names = long.columns[3:]
        step = F.struct("position", F.array(*(F.col(f"`{c}`") for c in names)).alias("v"))
        rows = long.groupBy("unit").agg(F.max("length").alias("length"), F.transform(F.sort_array(F.collect_list(step)), lambda s: s["v"]).alias("values"))
        n = self.config.sequence_length
        if not n:
            return rows.withColumn("mask", F.transform("values", lambda v: F.lit(True)))
        return rows.withColumns(self._padded(n, len(names)))

    def pieces(self, source: EventFrame | DataFrame, size: int = PIECE) -> DataFrame:
        """The sequences cut into rows of ``size`` steps, the last of each padded: unit, start, length of the unit, values and mask.

        For any length: a row holds no more than ``size`` steps, however uneven the units are,
        and no more than the longest sequence, so that short ones are not padded beyond it.
        """
        long = self.frame(source)
        size = min(size, (self.data(source).where(F.col(self.unit(source)).isNotNull()).groupBy(self.unit(source)).count().agg(F.max("count")).first()[0] or size))
        names = long.columns[3:]
        step = F.struct("position", F.array(*(F.col(f"`{c}`") for c in names)).alias("v"))
        start = (F.col("position") - F.pmod("position", F.lit(size))).cast("long")
        rows = long.groupBy("unit", start.alias("start")).agg(F.max("length").alias("length"), F.transform(F.sort_array(F.collect_list(step)), lambda s: s["v"]).alias("values"))
        return rows.withColumns(self._padded(size, len(names)))

    def _padded(self, n: int, width: int) -> dict[str, Column]:
        """Values up to ``n`` steps, and the mask."""
        gap = F.lit(n) - F.size("values")
        pad, off = F.array_repeat(F.array(*(F.lit(float(self.config.padding_value)) for _ in range(width))), gap), F.array_repeat(F.lit(False), gap)
        real = F.transform("values", lambda v: F.lit(True))
        left = self.config.padding_side == "left"
        return {"mask": F.concat(off, real) if left else F.concat(real, off), "values": F.concat(pad, F.col("values")) if left else F.concat(F.col("values"), pad)}

    def convert(self, event_frame: EventFrame | DataFrame) -> SequenceOutput:
        table = self.gather(self.frame(event_frame).orderBy("unit", "position"))
        names, c = table.column_names[3:], self.config
        units, first, inverse = np.unique(table["unit"].to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        lengths = table["length"].to_numpy()[first].astype(np.int64)
        t = c.sequence_length or int(lengths.max(initial=0))
        out = np.full((len(units), t, len(names)), c.padding_value, self.dtype)
        mask = np.zeros((len(units), t), bool)
        position = table["position"].to_numpy()
        if c.padding_side == "left":
            position = position + t - np.minimum(lengths, t)[inverse]
        for k, name in enumerate(names):
            out[inverse, position, k] = table[name].to_numpy()
        mask[inverse, position] = True
        return SequenceOutput(out, mask, units.tolist(), names, lengths, self._time(t), {"sequences": self.dtype, "masks": "bool"})

    def _time(self, t: int) -> np.ndarray | None:
        place = np.arange(t, dtype=np.float64)
        if self.config.time_encoding == "none":
            return None
        if self.config.time_encoding == "positional":
            return (place / max(1, t)).reshape(-1, 1).astype(self.dtype)
        rate = np.exp(np.arange(0, 16, 2) * (-np.log(10000.0) / 16))
        angle = place[:, None] * rate
        return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(t, 16).astype(self.dtype)

    def to_table(self, output: SequenceOutput) -> pa.Table:
        n, t = output.masks.shape
        unit, place = np.repeat(np.arange(n), t), np.tile(np.arange(t), n)
        cols = {"sequence": unit, "position": place, "mask": output.masks.ravel(), "length": np.repeat(output.lengths, t)}
        return pa.table(cols | {c: output.sequences[:, :, k].ravel() for k, c in enumerate(output.feature_names)})

    def from_table(self, table: pa.Table, plain: dict[str, Any]) -> SequenceOutput:
        names, n = plain["feature_names"], len(plain["sequence_ids"])
        t = table.num_rows // max(1, n)
        values = np.stack([table[c].to_numpy().reshape(n, t) for c in names], axis=2) if names else np.zeros((n, t, 0))
        mask = table["mask"].to_numpy(zero_copy_only=False).reshape(n, t)
        lengths = table["length"].to_numpy().reshape(n, t)[:, 0] if t else np.zeros(n, np.int64)
        return SequenceOutput(values, mask, **plain, lengths=lengths, time_encoding=self._time(t))

"""Tables for regression."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar, Literal

import numpy as np
import pandas as pd
import pyarrow as pa
from pydantic import BaseModel, Field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.adapters.base import BaseModalityAdapter, Output
from chronomesh.frame import EventFrame
from chronomesh.registry import ADAPTERS


class TableAdapterConfig(BaseModel):
    index_cols: list[str] = Field(default_factory=list)
    feature_cols: list[str] | None = None
    target_col: str | None = None
    offset_col: str | None = None
    weight_col: str | None = None
    categorical_encoding: Literal["passthrough", "ordinal", "onehot"] = "passthrough"
    include_intercept: bool = False
    dtype: Literal["float32", "float64"] = "float32"


@dataclass
class TableOutput(Output):
    data: pa.Table
    feature_names: list[str] = field(default_factory=list)
    target: str | None = None
    offset: str | None = None
    weights: str | None = None
    index_cols: list[str] = field(default_factory=list)
    dtypes: dict[str, str] = field(default_factory=dict)
    array_fields: ClassVar[tuple[str, ...]] = ("data",)

    def arrays(self) -> dict[str, np.ndarray]:
        shown = {c: self.data[c].to_numpy() for c in self.data.column_names}
        return {c: v.astype(str) if v.dtype == object else v for c, v in shown.items()}

    def to_pandas(self) -> pd.DataFrame:
        df = self.data.to_pandas()
        return df.set_index(self.index_cols) if self.index_cols else df

    def to_numpy(self, include_target: bool = False) -> np.ndarray:
        cols = [*self.feature_names, *([self.target] if include_target and self.target else [])]
        return np.column_stack([self.data[c].to_numpy() for c in cols]) if cols else np.zeros((self.data.num_rows, 0))

    def get_X_y(self) -> tuple[np.ndarray, np.ndarray | None]:
        return self.to_numpy(), self.data[self.target].to_numpy() if self.target else None


@ADAPTERS.decorator("table", tags={"tabular", "glm", "poisson"}, config_model=TableAdapterConfig)
class TableAdapter(BaseModalityAdapter):
    """Index, features, target, offset and weight columns, features in one type."""

    config_class, output_class, modality, formats = TableAdapterConfig, TableOutput, "table", ("parquet", "arrow")

    def _names(self, source: EventFrame | DataFrame) -> tuple[list[str], list[str], list[str]]:
        c, df = self.config, self.data(source)
        index = [x for x in c.index_cols if x in df.columns]
        roles = [x for x in (c.target_col, c.offset_col, c.weight_col) if x and x in df.columns]
        features = self.features(source, c.feature_cols, *index, *roles)
        return index, (["_intercept"] if c.include_intercept else []) + features, roles

    def frame(self, source: EventFrame | DataFrame) -> DataFrame:
        """The table as a DataFrame."""
        index, features, roles = self._names(source)
        kind = "float" if self.dtype == "float32" else "double"
        made = [(F.lit(1.0) if c == "_intercept" else self.numeric(c)).cast(kind).alias(c) for c in features]
        return self.data(source).select(*(c for c in index if c not in features), *made, *(c for c in roles if c not in [*features, *index]))

    def convert(self, event_frame: EventFrame | DataFrame) -> TableOutput:
        index, features, roles = self._names(event_frame)
        table, c = self.gather(self.frame(event_frame)), self.config
        have = lambda x: x if x in roles else None
        return TableOutput(table, features, have(c.target_col), have(c.offset_col), have(c.weight_col), index, {f.name: str(f.type) for f in table.schema})

    def to_table(self, output: TableOutput) -> pa.Table:
        return output.data

    def from_table(self, table: pa.Table, plain: dict[str, Any]) -> TableOutput:
        return TableOutput(table, **plain)

    def restore(self, arrays: dict[str, np.ndarray], plain: dict[str, Any]) -> TableOutput:
        return TableOutput(pa.table({k: pa.array(v) for k, v in arrays.items()}), **plain)

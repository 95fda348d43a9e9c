"""What all adapters share: input, formats, metadata, files.

An adapter's main result is a DataFrame in long or array form, of any size, and
:func:`write_parts` writes that from the executors in one of the file formats.
``convert`` gathers it as numpy arrays on the driver, behind a bound.
"""

from __future__ import annotations

import io
import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from chronomesh.frame import EventFrame
from chronomesh.schema import EventSchema

#: Types that count as features when none are named.
NUMERIC = ("float", "double", "int", "bigint")
#: Rows that ``convert`` gathers at most.
MAX_ROWS = 20_000_000


#: File formats and what they need; pickles are refused, since reading them runs code.
FORMATS = ("numpy", "pytorch", "json", "parquet", "arrow")


#: Formats of files in parts; JSON parts are lines of a text file, Arrow files lie in the rows of a Parquet file.
PARTS = ("json", "parquet", "arrow")


def write_parts(df: DataFrame, path: str, fmt: str) -> None:
    """A long or array form in a folder, of any size: each batch of rows of an executor is a document of the format.

    Nothing of it passes through the driver. A JSON document maps each column to the
    list of its values, as that of a whole output does; times are microseconds or days since 1970.
    """
    if fmt not in PARTS:
        raise ValueError(f"unsupported format for parts: {fmt}")
    if fmt == "json" and (odd := [c for c, kind in df.dtypes if "binary" in kind or "decimal" in kind or kind.startswith(("map", "struct", "interval"))]):
        raise ValueError(f"JSON parts do not hold the types of {odd}")

    plain = {pa.timestamp("us").id: pa.int64(), pa.date32().id: pa.int32()}

    def to_json(batches):
        for batch in batches:
            if batch.num_rows:
                cols = {c: v.cast(plain[v.type.id]) if v.type.id in plain else v for c, v in zip(batch.schema.names, batch.columns)}
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps({c: v.to_pylist() for c, v in cols.items()})])], ["value"])

    def to_arrow(batches):
        for batch in batches:
            if batch.num_rows:
                sink = io.BytesIO()
                with pa.ipc.new_file(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], ["content"])

    if fmt == "json":
        df.mapInArrow(to_json, "value string").write.text(path)
    elif fmt == "arrow":
        df.mapInArrow(to_arrow, "content binary").write.parquet(path)
    else:
        df.write.parquet(path)


def read_parts(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    """The rows that :func:`write_parts` wrote; their schema is that of the form."""
    if fmt not in PARTS:
        raise ValueError(f"unsupported format for parts: {fmt}")
    names = schema.fieldNames()

    def from_json(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = json.loads(text)
                yield pa.RecordBatch.from_arrays([pa.array(found[c], kinds[c]) for c in names], names)

    def from_arrow(batches):
        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_file(content.as_buffer()) as reader:
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    if fmt == "json":
        kinds = dict(zip(names, (to_arrow_type(f.dataType) for f in schema.fields)))
        return spark.read.text(path).mapInArrow(from_json, schema)
    if fmt == "arrow":
        return spark.read.schema("content binary").parquet(path).mapInArrow(from_arrow, schema)
    return spark.read.schema(schema).parquet(path)


@dataclass
class Output:
    """Arrays and plain values; fields named in ``array_fields`` are saved as arrays."""

    array_fields: ClassVar[tuple[str, ...]] = ()

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: v for k in self.array_fields if (v := getattr(self, k)) is not None}

    def plain(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in self.array_fields}

    def names(self) -> list[str]:
        """Names of the features, whatever the output calls them."""
        return list(next((v for k in ("feature_names", "channel_names", "state_names") if (v := getattr(self, k, None))), []))

    def described(self, modality: str, settings: dict[str, Any]) -> dict[str, Any]:
        """What a reader needs to know of the arrays: a plain mapping, so that it goes into JSON as it is."""
        arrays = {k: {"shape": list(v.shape), "type": str(v.dtype)} for k, v in self.arrays().items()}
        return {"modality": modality, "names": self.names(), "arrays": arrays, "settings": settings}

    def to_torch(self) -> dict[str, Any]:
        import torch

        return {k: torch.as_tensor(v) for k, v in self.arrays().items()}


def _plain(x: Any) -> Any:
    return x.item() if isinstance(x, np.generic) else x.tolist() if isinstance(x, np.ndarray) else str(x)


class BaseModalityAdapter(ABC):
    """An adapter with a config; keyword arguments override its fields."""

    config_class: ClassVar[type[BaseModel]]
    output_class: ClassVar[type[Output]]
    modality: ClassVar[str]
    #: Formats beside numpy and PyTorch.
    formats: ClassVar[tuple[str, ...]] = ()

    def __init__(self, config: BaseModel | None = None, **overrides: Any):
        self.config = self.config_class.model_validate({**(config.model_dump() if config else {}), **overrides})

    @abstractmethod
    def convert(self, event_frame: EventFrame | DataFrame) -> Any: ...

    def describe(self) -> str:
        return (type(self).__doc__ or "").strip()

    # -- input --------------------------------------------------------------
    @staticmethod
    def data(source: EventFrame | DataFrame) -> DataFrame:
        return source.df if isinstance(source, EventFrame) else source

    def timestamp(self, source: EventFrame | DataFrame) -> str:
        own = getattr(self.config, "timestamp_col", None)
        return own or (source.schema.timestamp_col if isinstance(source, EventFrame) else "timestamp")

    def place(self, source: EventFrame | DataFrame) -> tuple[str, str] | None:
        """Longitude and latitude columns: from the schema, or columns with names such as these."""
        if isinstance(source, EventFrame) and source.schema.lon_col and source.schema.lat_col:
            pair = (source.schema.lon_col, source.schema.lat_col)
            return pair if set(pair) <= set(source.df.columns) else None
        columns = self.data(source).columns
        lon = next((c for c in columns if c.lower() in ("lon", "lng", "longitude", "centroid_lon")), None)
        lat = next((c for c in columns if c.lower() in ("lat", "latitude", "centroid_lat")), None)
        return (lon, lat) if lon and lat else None

    def order(self, source: EventFrame | DataFrame) -> list[str]:
        tie = source.schema.id_col if isinstance(source, EventFrame) else None
        return [self.timestamp(source), *([tie] if tie and tie in self.data(source).columns else [])]

    def features(self, source: EventFrame | DataFrame, named: list[str] | None, *without: str | None) -> list[str]:
        df = self.data(source)
        if named is not None:
            return [c for c in named if c in df.columns]
        skip = {*without, self.timestamp(source)}
        if isinstance(source, EventFrame):
            schema: EventSchema = source.schema
            skip |= {schema.lat_col, schema.lon_col, schema.id_col}
        return [c for c, kind in df.dtypes if kind in NUMERIC and c not in skip]

    def numeric(self, col: str):
        """A feature in double precision; the output type comes last."""
        return F.col(f"`{col}`").cast("double")

    @property
    def dtype(self) -> str:
        return getattr(self.config, "dtype", "float32")

    def gather(self, df: DataFrame) -> pa.Table:
        table = df.limit(MAX_ROWS + 1).toArrow()
        if table.num_rows > MAX_ROWS:
            raise ValueError(f"more than {MAX_ROWS} rows to gather; use the DataFrame form")
        return table

    # -- files --------------------------------------------------------------
    def get_metadata(self, output: Any) -> dict[str, Any]:
        return output.described(self.modality, self.config.model_dump())

    def _sidecar(self, path: Path) -> Path:
        return path.with_name(path.name + ".meta.json")

    def _checked(self, fmt: str) -> str:
        fmt = str(fmt)
        if fmt not in FORMATS or fmt not in ("numpy", "pytorch", *self.formats):
            raise ValueError(f"unsupported format for {self.modality}: {fmt}")
        return fmt

    def serialize(self, output: Any, path: str | Path, fmt: str = "numpy") -> Path:
        """Write the output, and beside it a ``.meta.json`` with its description and plain values."""
        fmt, path = self._checked(fmt), Path(path)
        if fmt == "numpy" and path.suffix != ".npz":
            path = path.with_name(path.name + ".npz")
        getattr(self, f"_write_{fmt}")(output, path)
        side = {"metadata": self.get_metadata(output), "plain": output.plain(), "format": fmt}
        self._sidecar(path).write_text(json.dumps(side, default=_plain))
        return path

    def deserialize(self, path: str | Path, fmt: str = "numpy") -> Any:
        fmt, path = self._checked(fmt), Path(path)
        return getattr(self, f"_read_{fmt}")(path, json.loads(self._sidecar(path).read_text())["plain"])

    def _write_numpy(self, output: Any, path: Path) -> None:
        np.savez(path, **output.arrays())

    def _read_numpy(self, path: Path, plain: dict[str, Any]) -> Any:
        with np.load(path, allow_pickle=False) as found:
            return self.restore({k: found[k] for k in found.files}, plain)

    def _write_pytorch(self, output: Any, path: Path) -> None:
        import torch

        torch.save(output.to_torch(), path)

    def _read_pytorch(self, path: Path, plain: dict[str, Any]) -> Any:
        import torch

        return self.restore({k: v.numpy() for k, v in torch.load(path, weights_only=True).items()}, plain)

    def _write_json(self, output: Any, path: Path) -> None:
        path.write_text(json.dumps({k: v.tolist() for k, v in output.arrays().items()}, default=_plain))

    def _read_json(self, path: Path, plain: dict[str, Any]) -> Any:
        return self.restore({k: np.array(v) for k, v in json.loads(path.read_text()).items()}, plain)

    def _write_parquet(self, output: Any, path: Path) -> None:
        pq.write_table(self.to_table(output), path)

    def _read_parquet(self, path: Path, plain: dict[str, Any]) -> Any:
        return self.from_table(pq.read_table(path), plain)

    def _write_arrow(self, output: Any, path: Path) -> None:
        table = self.to_table(output)
        with pa.ipc.new_file(path, table.schema) as writer:
            writer.write_table(table)

    def _read_arrow(self, path: Path, plain: dict[str, Any]) -> Any:
        return self.from_table(pa.ipc.open_file(path).read_all(), plain)

    def restore(self, arrays: dict[str, np.ndarray], plain: dict[str, Any]) -> Any:
        names = {f.name for f in fields(self.output_class)}
        return self.output_class(**{k: v for k, v in {**plain, **arrays}.items() if k in names})

    def to_table(self, output: Any) -> pa.Table:
        raise ValueError(f"no table form of {self.modality}")

    def from_table(self, table: pa.Table, plain: dict[str, Any]) -> Any:
        raise ValueError(f"no table form of {self.modality}")

"""Writing frames."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame


class BaseOutputAdapter(ABC):
    """A sink for frames."""

    @abstractmethod
    def write(self, event_frame: EventFrame, **options: Any) -> None: ...


class FileSink(BaseOutputAdapter):
    """Files of any format that Spark writes, partitioned by columns or by year, month and day of the timestamp.

    The frame's metadata goes beside the data, as one line of JSON in
    ``{path}.meta``, through Spark, so that any store will do.
    """

    def __init__(self, path: str, format: str = "parquet", compression: str = "snappy", partition_by: Sequence[str] = (), mode: str = "overwrite"):
        self.path, self.format, self.compression, self.partition_by, self.mode = path, format, compression, list(partition_by), mode

    def write(self, event_frame: EventFrame, **options: Any) -> None:
        df, ts = event_frame.df, event_frame.schema.timestamp_col
        parts = {"year": F.year, "month": F.month, "day": F.dayofmonth}
        df = df.withColumns({c: parts[c](ts) for c in self.partition_by if c in parts and c not in df.columns})
        if self.partition_by:
            df = df.repartition(*self.partition_by, F.spark_partition_id() % 8)  # few files a partition, no hot task
        writer = df.write.mode(self.mode).format(self.format).options(**options)
        if self.format in ("parquet", "orc", "csv", "json"):
            writer = writer.option("compression", self.compression)
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).save(self.path)
        side = {"schema": event_frame.schema.model_dump(mode="json"), "metadata": event_frame.metadata.model_dump(mode="json")}
        df.sparkSession.createDataFrame([(json.dumps(side, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}.meta")


class StreamSink:
    """A stream's micro-batches through a function, or into files."""

    def __init__(self, checkpoint: str):
        self.checkpoint = checkpoint

    def each(self, df: DataFrame, fn: Callable[[DataFrame, int], None], available_now: bool = True):
        writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def files(self, df: DataFrame, path: str, format: str = "parquet", available_now: bool = True):
        writer = df.writeStream.format(format).option("checkpointLocation", self.checkpoint).option("path", path)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

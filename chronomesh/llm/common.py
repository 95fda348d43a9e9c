"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronomesh.plans.stage import shared_dir, staged

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: Rows and bytes of an Arrow batch, which is held in the worker at once: texts may be long, so one row at least makes a batch.
BATCH_ROWS, BATCH_BYTES = "1000", "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Tables written inside each open :func:`scratch`, innermost last.
_written: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it back.

    The files survive the loss of any executor, and nothing but the wanted columns
    is read again. With ``sweep`` the shuffles of the write go when it is done.
    """
    small_batches(df.sparkSession)
    with _sweeping(df.sparkSession) if sweep else contextlib.nullcontext():
        out = staged(df, name)
    for tables in _written[-1:]:
        tables.append(out)
    return out


@contextlib.contextmanager
def _sweeping(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside at its end; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that are written inside, for :func:`discard` once nothing reads them any more."""
    tables: list[DataFrame] = []
    _written.append(tables)
    try:
        yield tables
    finally:
        _written.remove(tables)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize`."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/") + "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and the next task should not pay for this one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives its memory back at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one batch to a dict of columns.

    ``fn`` may also be a callable class instance; it lives for one task, so it
    can keep caches between batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(frugal(run), schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    col = batch.column(column)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions_for(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))

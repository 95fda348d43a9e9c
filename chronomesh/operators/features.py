"""Functional operators: counts, windows, lags, encodings, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.time import micros, parse_duration
from chronomesh.operators.kernels import BLOCK, HALO, event_order, own_rows, sequenced

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}
#: Most values that may become columns of their own.
MAX_CATEGORIES = 1000


def _values(frame: EventFrame, col: str, most: int) -> list:
    """Sorted distinct values that are not null; they name columns, so they must be few."""
    found = [r[0] for r in frame.df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return found


def aggregate_counts(event_frame: EventFrame, group_by: Sequence[str], count_col: str = "event_count") -> EventFrame:
    """Rows per group; the other columns go."""
    df = event_frame.df.groupBy(*group_by).agg(F.count("*").alias(count_col))
    return event_frame.produced(df, "aggregate_counts", [count_col], group_by)


def aggregate_by_category(event_frame: EventFrame, group_by: Sequence[str], category_col: str, prefix: str = "count", max_categories: int = MAX_CATEGORIES) -> EventFrame:
    """Rows per group and category, a column ``{prefix}_{value}`` each; without categories ``{prefix}_total``."""
    values = _values(event_frame, category_col, max_categories)
    named = {f"{prefix}_{v}": F.count(F.when(F.col(category_col) == v, 1)) for v in values} or {f"{prefix}_total": F.count("*")}
    df = event_frame.df.groupBy(*group_by).agg(*(c.alias(k) for k, c in named.items()))
    return event_frame.produced(df, "aggregate_by_category", named, [*group_by, category_col])


def _parts(agg: str, value: Column) -> dict[str, Column]:
    """Aggregates of which those of two sets of rows can be merged."""
    x = value.cast("double")
    return {
        "sum": {"a": F.sum(value)}, "min": {"a": F.min(value)}, "max": {"a": F.max(value)}, "count": {"a": F.count(value)},
        "mean": {"n": F.count(x), "a": F.sum(x)}, "std": {"n": F.count(x), "a": F.avg(x), "s": F.var_pop(x)},
    }[agg]


def _merged(agg: str, p: dict[str, Column], q: dict[str, Column]) -> Column:
    """The aggregate of both sets; an empty one has null, and no rows."""
    a, b = p["a"], q["a"]
    if agg in ("min", "max", "count"):
        return F.least(a, b) if agg == "min" else F.greatest(a, b) if agg == "max" else a + b
    total = F.coalesce(a + b, a, b)
    if agg == "sum":
        return total
    n = p["n"] + q["n"]
    if agg == "mean":
        return F.when(n > 0, total / n)
    of = lambda c: F.coalesce(c, F.lit(0.0))
    apart = F.when((p["n"] > 0) & (q["n"] > 0), (a - b) * (a - b) * p["n"] * q["n"] / n).otherwise(F.lit(0.0))
    return F.when(n > 1, F.sqrt((of(p["s"]) * p["n"] + of(q["s"]) * q["n"] + apart) / (n - 1)))


def moving_window_aggregation(event_frame: EventFrame, window: str, group_by: Sequence[str], value_col: str, agg: str = "mean", output_col: str | None = None) -> EventFrame:
    """Aggregate of the group's rows of the last ``window`` of time, the row's own time included.

    Time is cut into blocks as long as the window, and each row goes to its own
    block and, for its value, to the next. A window is then the beginning of the
    row's block and the end of the one before: two running aggregates, merged. The
    work is that of sorting, however many rows a window has.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {agg}")
    out, width = output_col or f"{value_col}_{agg}_{window}", parse_duration(window)
    kind = event_frame.df.select(AGGREGATES[agg](value_col)).schema[0].dataType
    keys = [*group_by, BLOCK]
    own = event_frame.df.withColumn("_at", micros(event_frame.schema.timestamp_col)).withColumns({BLOCK: F.floor(F.col("_at") / width), HALO: F.lit(False)})
    later = own.select(*group_by, F.col(value_col).alias("_v"), (F.col("_at") + width).alias("_at"), (F.col(BLOCK) + 1).alias(BLOCK), F.lit(True).alias(HALO))
    df = own.withColumn("_v", F.col(value_col)).unionByName(later, allowMissingColumns=True)
    begun = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    # backward in time; at one time a row comes before those that are a whole window older, which are out
    ended = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), HALO).rowsBetween(Window.unboundedPreceding, 0)
    sides = {}
    for name, over, mine in (("_p", begun, ~F.col(HALO)), ("_q", ended, F.col(HALO))):
        sides |= {f"{name}{k}": c.over(over) for k, c in _parts(agg, F.when(mine, F.col("_v"))).items()}
    df = df.withColumns(sides)
    p, q = ({k: F.col(f"{name}{k}") for k in "nas" if f"{name}{k}" in sides} for name in ("_p", "_q"))
    df = own_rows(df.withColumn(out, _merged(agg, p, q).cast(kind)), [*(c for c in event_frame.df.columns if c != out), out])
    return event_frame.produced(df, "moving_window_aggregation", [out], [value_col, *group_by], window=window, agg=agg)


def shifted(col: str, k: int, window) -> Column:
    return F.lag(col, k).over(window) if k >= 0 else F.lead(col, -k).over(window)


def lag_features(event_frame: EventFrame, lag_col: str, lags: Sequence[int], group_by: Sequence[str] = ()) -> EventFrame:
    """Values of earlier (negative: later) rows, ``{col}_lag_{k}``."""
    order = event_order(event_frame)
    df, window = sequenced(event_frame.df, list(group_by or ()), order, [lag_col], max(0, *lags), max(0, *(-k for k in lags)))
    made = {f"{lag_col}_lag_{k}": shifted(lag_col, k, window) for k in lags}
    out = own_rows(df.withColumns(made), [*event_frame.df.columns, *made])
    return event_frame.produced(out, "lag_features", made, [lag_col, *(group_by or ())])


def compute_ratios(event_frame: EventFrame, numerator: str, denominator: str, output_col: str | None = None) -> EventFrame:
    """numerator / max(denominator, 1e-10); a null denominator gives null."""
    out = output_col or f"{numerator}_per_{denominator}"
    ratio = F.when(F.col(denominator).isNotNull(), F.col(numerator) / F.greatest(F.col(denominator).cast("double"), F.lit(1e-10)))
    return event_frame.produced(event_frame.df.withColumn(out, ratio), "compute_ratios", [out], [numerator, denominator])


def normalize_features(event_frame: EventFrame, cols: Sequence[str], method: str = "zscore") -> EventFrame:
    """``{col}_normalized``: z-scores (sample deviation) or positions between minimum and maximum; null where the spread is 0."""
    if method not in ("zscore", "minmax"):
        raise ValueError(f"unknown method: {method}")
    low, spread = (F.avg, F.stddev_samp) if method == "zscore" else (F.min, lambda c: F.max(c) - F.min(c))
    stats = event_frame.df.agg(*(x for i, c in enumerate(cols) for x in (low(c).alias(f"_a{i}"), spread(c).alias(f"_b{i}"))))
    made = {f"{c}_normalized": F.try_divide(F.col(c) - F.col(f"_a{i}"), F.col(f"_b{i}").cast("double")) for i, c in enumerate(cols)}
    df = event_frame.df.join(F.broadcast(stats)).withColumns(made).select(*event_frame.df.columns, *made)  # stats: one row
    return event_frame.produced(df, "normalize_features", made, cols, method=method)


def encode_categorical(event_frame: EventFrame, col: str, method: str = "onehot", prefix: str | None = None, max_categories: int = MAX_CATEGORIES) -> EventFrame:
    """One indicator ``{prefix}_{value}`` a value, or the ``ordinal`` place of the value, ``{col}_encoded``; nulls have none."""
    df = event_frame.df
    if method == "onehot":
        made = {f"{prefix or col}_{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in _values(event_frame, col, max_categories)}
        df = df.withColumns(made)
    elif method == "ordinal":
        made = {f"{col}_encoded": None}
        values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v")).distinct()
        ranks = values.select("_v", (F.row_number().over(Window.orderBy("_v")) - 1).cast("long").alias(f"{col}_encoded"))
        df = df.join(ranks, F.col(col) == F.col("_v"), "left").drop("_v")
    else:
        raise ValueError(f"unknown encoding: {method}")
    return event_frame.produced(df, "encode_categorical", made, [col], method=method)

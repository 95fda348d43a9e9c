"""Point-process and survival steps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.geo import METRES_PER_DEGREE, haversine
from chronomesh.functions.time import micros, seconds, whole_seconds
from chronomesh.operators.kernels import decayed_sum, event_order, neighbours, own_rows, running, sequenced
from chronomesh.operators.spatial import coordinates, unused
from chronomesh.pipeline import Step
from chronomesh.plans.stage import staged
from chronomesh.registry import step


def positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


@step("exponential_decay", "temporal", "continuous")
@dataclass
class ExponentialDecayStep(Step):
    """exp(-rate * age), age in whole seconds before the last event of all or of the group."""

    decay_rate: float = 0.1
    time_unit: str = "1h"
    output_col: str = "decay_weight"
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        positive(decay_rate=self.decay_rate)

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts, df, keys = event_frame.schema.timestamp_col, event_frame.df, list(self.group_cols)
        last = df.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.max(ts).alias("_last"))
        if keys:
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            joined = df.join(last, on, "left")
        else:
            joined = df.join(F.broadcast(last))  # one row
        rate = self.decay_rate / seconds(self.time_unit)
        made = F.exp(F.lit(-rate) * whole_seconds(F.col(ts), F.col("_last")))
        out = joined.withColumn(self.output_col, made).select(*(c for c in df.columns if c != self.output_col), self.output_col)
        return event_frame.produced(out, self.step_name, [self.output_col], [ts, *keys], ["temporal", "continuous"])


@step("hawkes_kernel", "temporal", "continuous")
@dataclass
class HawkesKernelStep(Step):
    """Triggering of each event by up to ``max_history`` earlier ones: alpha * beta * exp(-beta * gap)."""

    alpha: float = 0.5
    beta: float = 1.0
    mu: float = 0.1
    time_unit: str = "1h"
    max_history: int = 100
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        positive(alpha=self.alpha, beta=self.beta, mu=self.mu, max_history=self.max_history)
        if self.alpha >= 1:
            raise ValueError("alpha must be below 1: the process would explode")

    def run(self, event_frame: EventFrame) -> EventFrame:
        order = event_order(event_frame)
        ts, rate = order[0], self.beta / seconds(self.time_unit)
        df, window = sequenced(event_frame.df, list(self.group_cols), order, [], self.max_history)
        df = df.withColumn("_us", micros(ts))
        history = F.collect_list("_us").over(window.rowsBetween(-self.max_history, -1))
        df = df.withColumn("_hist", history)
        trigger = F.aggregate("_hist", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("_us")) * F.lit(rate / 1e6))) * F.lit(self.alpha * self.beta)
        made = {"hawkes_trigger": trigger, "hawkes_background": F.lit(float(self.mu))}
        df = df.withColumns(made).withColumn("hawkes_intensity", F.col("hawkes_trigger") + F.lit(float(self.mu)))
        names = ["hawkes_intensity", "hawkes_trigger", "hawkes_background"]
        out = own_rows(df, [*event_frame.df.columns, *names])
        return event_frame.produced(out, self.step_name, names, [ts, *self.group_cols], ["temporal", "continuous"])


#: Distinct times of one chunk, a row of the staged table; times that are compared one with another.
CHUNK, NEAR = 4096, 256
#: Distance of the nodes of the integral below, and the last of them: exp(2 x - e^x) is 1e-20 there.
NODE, LAST_NODE = 0.24, 4.0


def _power_law_terms(reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and weights: (1 + g)^-2 as a sum of weight * exp(-rate * g), for g from 0 to ``reach``.

    It is the integral of exp(2 x - e^x (1 + g)) over x. The trapezoid rule has a relative
    error of 2 |Gamma(2 + 2 pi i / NODE)|, 1e-15; what is cut off below is less than that.
    """
    x = np.arange(LAST_NODE, -19.6 - math.log1p(reach), -NODE)
    return np.exp(x), NODE * np.exp(2 * x - np.exp(x))


def _power_law_sums(df: DataFrame, ts: str, width: float) -> DataFrame:
    """Per distinct time ``_us``: ``_earlier``, the sum of (1 + gap / width)^-2 over all events before it.

    The nearest times are compared one by one. All that lie farther back enter as
    decaying sums, one for each of some hundred rates, which are carried from
    chunk to chunk in a table of one row a chunk. The work is in proportion to the times.
    """
    times = df.where(F.col(ts).isNotNull()).groupBy(micros(ts).alias("_us")).agg(F.min(ts).alias(ts), F.count("*").alias("_n"))
    placed = running(times, [], [ts], {"_pos": F.lit(1)}).withColumn("_chunk", F.floor((F.col("_pos") - 1) / CHUNK))
    rows = F.sort_array(F.collect_list(F.struct(F.col("_us").alias("us"), F.col("_n").alias("n"))))
    chunks = staged(placed.groupBy("_chunk").agg(rows.alias("_rows")).select("_chunk", F.col("_rows.us").alias("_us"), F.col("_rows.n").alias("_n")))  # CHUNK rows at most
    low, high = chunks.agg(F.min(F.col("_us")[0]), F.max(F.element_at("_us", -1))).first()
    unit = 1e6 * width
    rates, weights = _power_law_terms(((high or 0) - (low or 0)) / unit)

    def decays(gap: np.ndarray) -> np.ndarray:
        return np.exp(-np.outer(gap / unit, rates))

    def blocks(batch: pa.RecordBatch):
        for k in range(batch.num_rows):
            us, n = (batch.column(c)[k].values.to_numpy() for c in ("_us", "_n"))
            yield k, us, n.astype(np.float64)

    def summed(batches):
        for batch in batches:
            out = [(batch.column("_chunk")[k].as_py(), us[-1].item(), n @ decays(us[-1] - us)) for k, us, n in blocks(batch)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["_chunk", "_end", "_state"])

    def carried(batches):
        state, at = np.zeros(len(rates)), None
        for batch in batches:
            out = []
            for k, end, own in zip(*(batch.column(c).to_pylist() for c in ("_chunk", "_end", "_state"))):
                if at is not None:
                    out.append((k, at, state.tolist()))
                    state = state * decays(np.array([end - at]))[0]
                state, at = state + np.array(own), end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["_k", "_at", "_state"])

    def spread(batches):
        for batch in batches:
            for k, us, n in blocks(batch):
                at, state = batch.column("_at")[k].as_py(), np.zeros(len(rates))
                if at is not None:
                    state = batch.column("_state")[k].values.to_numpy()
                out = np.zeros(len(us))
                for i in range(0, len(us), NEAR):
                    own, m = us[i : i + NEAR], n[i : i + NEAR]
                    if at is not None:
                        out[i : i + NEAR] = decays(own - at) @ (weights * state)
                    gap = (own[:, None] - own[None, :]).astype(np.float64)
                    term = np.square(1.0 / (1.0 + np.maximum(gap, 0.0) / unit))
                    term[gap <= 0] = 0.0
                    out[i : i + NEAR] += term @ m
                    if at is not None:
                        state = state * decays(own[-1:] - at)[0]
                    state, at = state + m @ decays(own[-1] - own), own[-1]
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(out)], ["_us", "_earlier"])

    states = staged(chunks.mapInArrow(summed, "_chunk long, _end long, _state array<double>"))
    before = staged(states.repartition(1).sortWithinPartitions("_chunk").mapInArrow(carried, "_k long, _at long, _state array<double>"))
    joined = chunks.join(before, F.col("_chunk") == F.col("_k"), "left").select("_us", "_n", "_at", "_state")
    return staged(joined.mapInArrow(spread, "_us long, _earlier double"))


@step("conditional_intensity", "temporal", "continuous")
@dataclass
class ConditionalIntensityStep(Step):
    """Sum of a kernel over the gaps to all earlier events.

    exponential: exp(-gap / bandwidth); hawkes: half of it; power_law:
    (1 + gap / bandwidth)^-2. The first event has 1 / (n * unit). The exponential
    ones are scans over blocks of time; the power law is a sum of such scans, to
    the last digits of double precision (:func:`_power_law_terms`).
    """

    method: str = "exponential"
    bandwidth: float = 1.0
    time_unit: str = "1h"
    normalize: bool = True

    def __post_init__(self) -> None:
        positive(bandwidth=self.bandwidth)
        if self.method not in ("exponential", "hawkes", "power_law"):
            raise ValueError(f"unknown method: {self.method}")

    def run(self, event_frame: EventFrame) -> EventFrame:
        order, df, unit = event_order(event_frame), event_frame.df, seconds(self.time_unit)
        ts, width = order[0], self.bandwidth * unit
        if self.method == "power_law":
            ties = Window.partitionBy("_t").orderBy(*order)
            sums = _power_law_sums(df, ts, width)
            rows = df.withColumn("_t", micros(ts)).withColumn("_ties", F.row_number().over(ties) - 1).join(sums, F.col("_t") == F.col("_us"), "left")
            rows = rows.withColumn("_sum", F.col("_earlier") + F.col("_ties")).select(*df.columns, "_sum")
        else:
            rows = decayed_sum(df, [], order, F.lit(0.5 if self.method == "hawkes" else 1.0), 1 / width, "_sum", include_self=False)
        stats = df.agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
        first = F.struct(*order) == F.col("_first")
        value = F.when(first, 1.0 / (F.col("_n") * F.lit(unit))).otherwise(F.col("_sum"))
        rows = rows.join(F.broadcast(stats)).withColumn("conditional_intensity", value)  # one row
        names = ["conditional_intensity"]
        if self.normalize:
            most = rows.agg(F.max("conditional_intensity").alias("_most"))
            share = F.when(F.col("_most") > 0, F.col("conditional_intensity") / F.col("_most")).otherwise(F.col("conditional_intensity"))
            rows = rows.join(F.broadcast(most)).withColumn("intensity_normalized", share)
            names.append("intensity_normalized")
        return event_frame.produced(rows.select(*df.columns, *names), self.step_name, names, [ts], ["temporal", "continuous"], method=self.method)


def _points(frame: EventFrame) -> DataFrame:
    """Distinct places with the number of their events."""
    lon, lat = coordinates(frame)
    return frame.df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).agg(F.count("*").alias("_n"))


#: Places of a cell with which a search for neighbours may start.
CROWD = 64


def _cell_of(metres: float, top: float) -> tuple[float, float]:
    """Degrees of longitude and latitude that are so many metres at least, up to the latitude ``top``."""
    dy = metres / METRES_PER_DEGREE
    return min(360.0, dy / max(1e-6, math.cos(math.radians(min(89.9, top + dy))))), dy


def _pairs(points: DataFrame, other: DataFrame, metres: float, top: float) -> DataFrame:
    """Pairs within ``metres`` of each other, with ``_d``; cells are widened for the latitude furthest from the equator."""
    dx, dy = _cell_of(metres, top)
    both = points.withColumn("_own", F.lit(True)).unionByName(other.withColumn("_own", F.lit(False))) if other is not points else None
    near = neighbours(points if both is None else both, "_x", "_y", dx, dy, "_n", [] if both is None else ["_own"])
    if both is not None:
        near = near.where("_own and not _own_n")
    return near.withColumn("_d", haversine(F.col("_x"), F.col("_y"), F.col("_x_n"), F.col("_y_n"))).where(F.col("_d") <= metres)


def _back(frame: EventFrame, found: DataFrame, name: str) -> DataFrame:
    lon, lat = coordinates(frame)
    on = (F.col(lon).cast("double") == F.col("_x")) & (F.col(lat).cast("double") == F.col("_y"))
    return frame.df.drop(name).join(found, on, "left").drop("_x", "_y")


@step("pair_correlation", "spatial", "continuous")
@dataclass
class PairCorrelationStep(Step):
    """``nearest_neighbor_distance``: great-circle metres to the nearest other event, 0 if there is none.

    The search widens its radius for those that have found none yet. It starts at
    one sixteenth of ``max_distance`` or twice the mean spacing, or less where
    events crowd: no cell of the first radius holds more than CROWD places.
    :func:`ripley_table` has g(r) itself.
    """

    max_distance: float = 1000.0
    n_bins: int = 50
    edge_correction: bool = True

    def __post_init__(self) -> None:
        positive(max_distance=self.max_distance)
        unused(self, n_bins=50, edge_correction=True)

    def run(self, event_frame: EventFrame) -> EventFrame:
        name, points = "nearest_neighbor_distance", _points(event_frame)
        points = staged(points)
        top, n, width, height = points.agg(F.max(F.abs("_y")), F.count("*"), F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).first()
        found = points.where("_n > 1").select("_x", "_y", F.lit(0.0).alias(name))
        left = points.where("_n = 1")
        reach = max(self.max_distance / 16, 2 * METRES_PER_DEGREE * math.sqrt((width or 0.0) * (height or 0.0) / max(1, n)))
        while n and reach > 0.01:
            dx, dy = _cell_of(reach, top)
            if points.groupBy(F.floor(F.col("_x") / dx), F.floor(F.col("_y") / dy)).count().agg(F.max("count")).first()[0] <= CROWD:
                break
            reach /= 4
        while n and n > 1:
            hits = _pairs(left, points, reach, top).where("_d > 0 or _x <> _x_n or _y <> _y_n").groupBy("_x", "_y").agg(F.min("_d").alias(name))
            hits = staged(hits)
            found = found.union(hits)
            left = left.join(hits, ["_x", "_y"], "left_anti")
            if reach > 21_000_000 or left.isEmpty():
                break
            reach *= 4
        df = _back(event_frame, found, name).withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
        return event_frame.produced(df, self.step_name, [name], coordinates(event_frame), ["spatial", "continuous"])


@step("k_function", "spatial", "continuous")
@dataclass
class KFunctionStep(Step):
    """Number of other events within ``max_distance`` metres, as it is (K) or as sqrt(k / pi) (L), or that less r / 2 (H)."""

    max_distance: float = 1000.0
    n_bins: int = 50
    edge_correction: str = "ripley"
    transform: str = "L"

    def __post_init__(self) -> None:
        positive(max_distance=self.max_distance)
        unused(self, n_bins=50, edge_correction="ripley")
        if self.transform not in ("K", "L", "H"):
            raise ValueError(f"unknown transform: {self.transform}")

    def run(self, event_frame: EventFrame) -> EventFrame:
        name, points = f"{self.transform.lower()}_function_local", _points(event_frame)
        top = points.agg(F.max(F.abs("_y"))).first()[0] or 0.0
        counts = _pairs(points, points, self.max_distance, top).groupBy("_x", "_y").agg((F.sum("_n_n") - 1).alias("_k"))
        k = F.coalesce(F.col("_k"), F.lit(0))
        root = F.sqrt(k / F.lit(math.pi))
        value = {"K": k.cast("double"), "L": root, "H": F.when(k > 0, root - self.max_distance / 2).otherwise(F.lit(0.0))}[self.transform]
        df = _back(event_frame, counts, name).withColumn(name, value).drop("_k")
        return event_frame.produced(df, self.step_name, [name], coordinates(event_frame), ["spatial", "continuous"])


def ripley_table(event_frame: EventFrame, max_distance: float = 1000.0, n_bins: int = 50, area_m2: float | None = None) -> DataFrame:
    """Ripley's K, L and H and the pair correlation g by distance: columns r, k, l, h, g, without edge correction."""
    points = _points(event_frame)
    top, n, x0, x1, y0, y1 = points.agg(F.max(F.abs("_y")), F.sum("_n"), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    n = n or 0
    step_m = max_distance / n_bins
    if area_m2 is None and n:
        area_m2 = max(1.0, (x1 - x0) * METRES_PER_DEGREE * math.cos(math.radians((y0 + y1) / 2)) * (y1 - y0) * METRES_PER_DEGREE)
    spark = event_frame.df.sparkSession
    same = points.agg(F.coalesce(F.sum(F.col("_n") * (F.col("_n") - 1)), F.lit(0)).alias("_w")).select(F.lit(0).cast("long").alias("_b"), "_w")
    pairs = _pairs(points, points, max_distance, top or 0.0).where("_x <> _x_n or _y <> _y_n")
    bins = pairs.select(F.least(F.floor(F.col("_d") / step_m), F.lit(n_bins - 1)).alias("_b"), (F.col("_n") * F.col("_n_n")).alias("_w")).union(same)
    counts = spark.range(n_bins).select(F.col("id").alias("_b")).join(bins.groupBy("_b").agg(F.sum("_w").alias("_w")), "_b", "left")
    total = F.sum(F.coalesce("_w", F.lit(0))).over(Window.orderBy("_b"))  # one row a bin
    r, scale = (F.col("_b") + 1) * F.lit(step_m), (area_m2 or 0.0) / max(1, n * (n - 1))
    table = counts.select(r.alias("r"), (total * scale).alias("k"), (F.coalesce("_w", F.lit(0)) * scale / (F.lit(2 * math.pi * step_m) * (F.col("_b") + 0.5) * step_m)).alias("g"))
    return table.select("r", "k", F.sqrt(F.col("k") / math.pi).alias("l"), (F.sqrt(F.col("k") / math.pi) - F.col("r")).alias("h"), "g")


def _ranked(frame: EventFrame, keys: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """Events with their place i (from 0) and number n."""
    df = running(frame.df, list(keys), event_order(frame), {"_rank": F.lit(1)}, totals=True)
    return df, F.col("_rank") - 1, F.col("_rank_total")


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, from a table up to 63 and by Euler and Maclaurin's series beyond."""
    table = F.array(*(F.lit(math.fsum(1 / k for k in range(1, m + 1))) for m in range(64)))
    x = F.greatest(n, F.lit(1)).cast("double")
    series = F.ln(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0)))
    return F.when(n < 64, F.get(table, F.greatest(F.least(n, F.lit(63)), F.lit(0)).cast("int"))).otherwise(series)


@step("hazard_rate", "temporal", "continuous")
@dataclass
class HazardRateStep(Step):
    """Nelson-Aalen: ``cumulative_hazard`` sums 1 / (n - j); ``hazard_rate`` divides by the gap of at least a second."""

    method: str = "nelson_aalen"
    bandwidth: float = 1.0
    n_intervals: int = 10
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        unused(self, method="nelson_aalen", bandwidth=1.0, n_intervals=10)

    def run(self, event_frame: EventFrame) -> EventFrame:
        order, keys = event_order(event_frame), list(self.group_cols)
        ts, columns = order[0], event_frame.df.columns
        df, i, n = _ranked(event_frame, keys)
        df = df.withColumns({"_i": i, "_c": n})
        share = 1.0 / (F.col("_c") - F.col("_i"))
        # the sum over the rows so far is a difference of two harmonic numbers
        df = df.withColumn("cumulative_hazard", harmonic(F.col("_c")) - harmonic(F.col("_c") - F.col("_i") - 1))
        df, window = sequenced(df, keys, order, [], 1)
        gap = (micros(ts) - micros(F.lag(ts).over(window))) / F.lit(1e6)
        rate = F.when(F.col("_i") == 0, 1.0 / F.col("_c")).when(gap > 0, share / F.greatest(gap, F.lit(1.0))).otherwise(F.lit(0.0))
        names = ["hazard_rate", "cumulative_hazard"]
        out = own_rows(df.withColumn("hazard_rate", rate), [*(c for c in columns if c not in names), *names])
        return event_frame.produced(out, self.step_name, names, [ts, *keys], ["temporal", "continuous"])


@step("survival_table", "temporal", "continuous")
@dataclass
class SurvivalTableStep(Step):
    """Kaplan-Meier with an end at every row, Greenwood's bounds clipped to [0, 1]: S_i = (n - i - 1) / n.

    The bounds are as many deviations away as the normal distribution has at the
    confidence level; 1.96 and 1.645 at 0.95 and 0.90.
    """

    method: str = "kaplan_meier"
    confidence_level: float = 0.95
    time_points: Sequence[float] | None = None
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        unused(self, method="kaplan_meier", time_points=None)
        if not 0 < self.confidence_level < 1:
            raise ValueError("confidence_level must lie between 0 and 1")

    def run(self, event_frame: EventFrame) -> EventFrame:
        columns = event_frame.df.columns
        df, i, n = _ranked(event_frame, self.group_cols)
        # the two usual levels by the figures that everybody writes
        z = {0.95: 1.96, 0.9: 1.645}.get(self.confidence_level) or NormalDist().inv_cdf((1 + self.confidence_level) / 2)
        left = n - i - 1
        s = left / n
        error = F.when(left > 0, s * F.sqrt(1.0 / F.greatest(left, F.lit(1)) - 1.0 / n)).otherwise(F.lit(0.0))
        made = {
            "survival_probability": s,
            "survival_lower": F.greatest(F.lit(0.0), s - z * error),
            "survival_upper": F.least(F.lit(1.0), s + z * error),
        }
        out = df.withColumns(made).select(*(c for c in columns if c not in made), *made)
        return event_frame.produced(out, self.step_name, made, [event_frame.schema.timestamp_col, *self.group_cols], ["temporal", "continuous"])


@step("duration_features", "temporal", "continuous")
@dataclass
class DurationFeaturesStep(Step):
    """Whole seconds since the last and to the next event, and decays of the former; names may hold dots."""

    decay_functions: Sequence[str] = ("exponential",)
    decay_rates: Sequence[float] = (0.1, 0.5, 1.0)
    power_exponents: Sequence[float] = (0.5, 1.0, 2.0)
    include_time_to_next: bool = True
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        if odd := [f for f in self.decay_functions if f not in ("exponential", "power_law", "linear", "logarithmic")]:
            raise ValueError(f"unknown decays: {odd}")

    def run(self, event_frame: EventFrame) -> EventFrame:
        order = event_order(event_frame)
        ts = order[0]
        df, window = sequenced(event_frame.df, list(self.group_cols), order, [], 1, int(self.include_time_to_next))
        made = {"time_since_last": whole_seconds(F.lag(ts).over(window), F.col(ts))}
        if self.include_time_to_next:
            made["time_to_next"] = whole_seconds(F.col(ts), F.lead(ts).over(window))
        df = df.withColumns(made)
        x = F.coalesce(F.col("time_since_last"), F.lit(0)).cast("double")
        hours = x / 3600
        if "exponential" in self.decay_functions:
            made |= {f"time_since_last_exp_{r}": F.exp(-r * hours) for r in self.decay_rates}
        if "power_law" in self.decay_functions:
            made |= {f"time_since_last_pow_{p}": 1 / F.pow(1 + hours, F.lit(float(p))) for p in self.power_exponents}
        if "linear" in self.decay_functions:
            made["time_since_last_linear"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - x / 86400))
        if "logarithmic" in self.decay_functions:
            made["time_since_last_log"] = 1 / (1 + F.ln(hours + 1))
        df = df.withColumns({k: c for k, c in made.items() if k not in ("time_since_last", "time_to_next")})
        out = own_rows(df, [*event_frame.df.columns, *made])
        return event_frame.produced(out, self.step_name, made, [ts, *self.group_cols], ["temporal", "continuous"])


@step("continuous_inter_event", "temporal", "continuous")
@dataclass
class ContinuousInterEventStep(Step):
    """Whole seconds between events, their logarithm, share of the mean, rolling mean, deviation and variation."""

    include_log_transform: bool = True
    include_normalized: bool = True
    rolling_windows: Sequence[int] = (5, 10, 20)
    include_coefficient_variation: bool = True
    group_cols: Sequence[str] = ()

    def run(self, event_frame: EventFrame) -> EventFrame:
        order, keys = event_order(event_frame), list(self.group_cols)
        ts, columns = order[0], event_frame.df.columns
        df, window = sequenced(event_frame.df, keys, order, [], 1 + max([1, *self.rolling_windows]))
        gap = "inter_event_seconds"
        df = df.withColumn(gap, whole_seconds(F.lag(ts).over(window), F.col(ts)))
        made = {}
        if self.include_log_transform:
            made["inter_event_log"] = F.ln(F.coalesce(F.col(gap), F.lit(1)) + 1)
        for w in self.rolling_windows:
            rows = window.rowsBetween(-(w - 1), 0)
            made |= {f"inter_event_mean_{w}": F.avg(gap).over(rows), f"inter_event_std_{w}": F.stddev_samp(gap).over(rows)}
        df = own_rows(df.withColumns(made), [*columns, gap, *made])
        if self.include_normalized:
            means = df.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.avg(gap).alias("_mean"))
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            mean = F.col("_mean") if keys else F.when(F.coalesce(F.col("_mean"), F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.col("_mean"))
            df = df.join(means if keys else F.broadcast(means), on, "left").withColumn("inter_event_normalized", F.try_divide(F.col(gap).cast("double"), mean))
            made["inter_event_normalized"] = None
        if self.include_coefficient_variation:
            cv = {f"inter_event_cv_{w}": F.try_divide(F.col(f"inter_event_std_{w}"), F.coalesce(F.col(f"inter_event_mean_{w}"), F.lit(1.0))) for w in self.rolling_windows}
            df, made = df.withColumns(cv), made | cv
        return event_frame.produced(df.select(*columns, gap, *made), self.step_name, [gap, *made], [ts, *keys], ["temporal", "continuous"])

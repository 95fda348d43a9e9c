"""Spatial steps and functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.geo import plane_distance, project, validate_bounds
from chronomesh.operators.features import AGGREGATES
from chronomesh.operators.kernels import event_order, neighbours
from chronomesh.operators.shapes import locate
from chronomesh.pipeline import Step
from chronomesh.registry import step

#: A cell's number is its row times this plus its column.
ROW = 100_000


def coordinates(frame: EventFrame) -> tuple[str, str]:
    """Longitude and latitude columns; ValueError without them."""
    if not (frame.schema.lon_col and frame.schema.lat_col):
        raise ValueError("this needs latitude and longitude columns")
    return frame.schema.lon_col, frame.schema.lat_col


def as_frame(data: DataFrame | str) -> DataFrame:
    """A DataFrame, or the name of a table or the path of a Parquet file."""
    if isinstance(data, DataFrame):
        return data
    spark = SparkSession.active()
    return spark.read.parquet(data) if "/" in data else spark.table(data)


@step("transform_crs", "spatial")
@dataclass
class TransformCRSStep(Step):
    """Projected coordinates, ``{lon}_proj`` and ``{lat}_proj``."""

    target_crs: str

    def run(self, event_frame: EventFrame) -> EventFrame:
        lon, lat = coordinates(event_frame)
        if self.target_crs == event_frame.metadata.crs:
            return event_frame
        x, y = project(F.col(lon), F.col(lat), event_frame.metadata.crs, self.target_crs)
        made = {f"{lon}_proj": x, f"{lat}_proj": y}
        out = event_frame.produced(event_frame.df.withColumns(made), self.step_name, made, [lon, lat], ["spatial"], target_crs=self.target_crs)
        return out.with_metadata(crs=self.target_crs).require_context(spatial_crs=self.target_crs)


def transform_crs(event_frame: EventFrame, target_crs: str) -> EventFrame:
    return TransformCRSStep(target_crs).run(event_frame)


def create_grid(spark: SparkSession, bounds: tuple[float, float, float, float], size_m: float, crs: str = "EPSG:4326") -> DataFrame:
    """Cells in rows from the lower left: grid_id, minx, miny, maxx, maxy, geometry (WKT)."""
    minx, miny, maxx, maxy = validate_bounds(bounds)
    if size_m <= 0:
        raise ValueError("the cell size must be positive")
    n_cols, n_rows = int((maxx - minx) / size_m) + 1, int((maxy - miny) / size_m) + 1
    x0, y0 = F.lit(minx) + F.col("grid_id") % n_cols * F.lit(float(size_m)), F.lit(miny) + F.floor(F.col("grid_id") / n_cols) * F.lit(float(size_m))
    cells = spark.range(n_cols * n_rows).select(F.col("id").alias("grid_id")).select("grid_id", x0.alias("minx"), y0.alias("miny"), (x0 + size_m).alias("maxx"), (y0 + size_m).alias("maxy"))
    box = F.format_string("POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))", *(F.col(c).cast("string") for c in ("minx", "miny", "maxx", "miny", "maxx", "maxy", "minx", "maxy", "minx", "miny")))
    return cells.withColumn("geometry", box)


def assign_to_grid(event_frame: EventFrame, bounds: tuple[float, float, float, float], size_m: float) -> EventFrame:
    """Cell numbers of :func:`create_grid`, row times columns plus column; no check of the bounds."""
    lon, lat = coordinates(event_frame)
    if size_m <= 0:
        raise ValueError("the cell size must be positive")
    minx, miny, maxx, _ = bounds
    n_cols = int((maxx - minx) / size_m) + 1
    cell = F.floor((F.col(lat) - miny) / size_m) * n_cols + F.floor((F.col(lon) - minx) / size_m)
    return event_frame.produced(event_frame.df.withColumn("grid_id", cell), "assign_to_grid", ["grid_id"], [lon, lat], ["spatial"]).with_metadata(grid_size_m=size_m)


@step("assign_to_grid", "spatial")
@dataclass
class AssignToGridStep(Step):
    """``grid_id``: row times 100000 plus column, counted from the origin (default: the least coordinates)."""

    grid_size_m: float = 500.0
    origin: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.grid_size_m <= 0:
            raise ValueError("grid_size_m must be positive")

    def run(self, event_frame: EventFrame) -> EventFrame:
        lon, lat = coordinates(event_frame)
        df = event_frame.df
        if self.origin is None:
            df = df.join(F.broadcast(df.agg(F.min(lon).alias("_x0"), F.min(lat).alias("_y0"))))  # one row
        else:
            df = df.withColumns({"_x0": F.lit(float(self.origin[0])), "_y0": F.lit(float(self.origin[1]))})
        row, col = (F.floor((F.col(c) - F.col(o)) / F.lit(float(self.grid_size_m))) for c, o in ((lat, "_y0"), (lon, "_x0")))
        df = df.withColumn("grid_id", row * ROW + col).drop("_x0", "_y0")
        out = event_frame.produced(df, self.step_name, ["grid_id"], [lon, lat], ["spatial"], grid_size_m=self.grid_size_m)
        return out.with_metadata(grid_size_m=self.grid_size_m)


def _zoned(frame: EventFrame, zones: DataFrame | str, zone_id_col: str, zone_geom_col: str, name: str) -> EventFrame:
    lon, lat = coordinates(frame)
    points = frame.df.select(F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"))
    hits = locate(points, as_frame(zones).select(F.col(zone_id_col).alias("_z"), F.col(zone_geom_col).alias("_wkt")), "_wkt", ["_z"])
    hits = hits.select("_x", "_y", F.col("_p")["_z"].try_cast("int").alias("zone_id"))
    df = frame.df.drop("zone_id").join(hits, (F.col(lon) == F.col("_x")) & (F.col(lat) == F.col("_y")), "left").drop("_x", "_y")
    return frame.produced(df, name, ["zone_id"], [lon, lat], ["spatial"])


@step("assign_to_zones", "spatial")
@dataclass
class AssignToZonesStep(Step):
    """``zone_id`` of the zone that contains the point (the least id of several); points on a boundary have none."""

    zones: Any
    zone_id_col: str = "zone_id"
    zone_geom_col: str = "geometry"

    def run(self, event_frame: EventFrame) -> EventFrame:
        return _zoned(event_frame, self.zones, self.zone_id_col, self.zone_geom_col, self.step_name)


def assign_to_zones(event_frame: EventFrame, zones: DataFrame | str, zone_id_col: str = "zone_id", zone_geom_col: str = "geometry") -> EventFrame:
    return _zoned(event_frame, zones, zone_id_col, zone_geom_col, "assign_to_zones")


#: Points of interest become columns, so they must be few.
MAX_POIS = 1000


@step("compute_distances", "spatial")
@dataclass
class ComputeDistancesStep(Step):
    """Plane distances to points of interest, ``dist_to_{name}``."""

    pois: Any
    poi_lon_col: str = "longitude"
    poi_lat_col: str = "latitude"
    poi_name_col: str = "name"

    def run(self, event_frame: EventFrame) -> EventFrame:
        lon, lat = coordinates(event_frame)
        rows = as_frame(self.pois).select(self.poi_name_col, self.poi_lon_col, self.poi_lat_col).orderBy(self.poi_name_col).limit(MAX_POIS + 1).collect()
        if len(rows) > MAX_POIS:
            raise ValueError(f"more than {MAX_POIS} points of interest")
        made = {f"dist_to_{n}": plane_distance(F.col(lon), F.col(lat), F.lit(float(x)), F.lit(float(y))) for n, x, y in rows}
        return event_frame.produced(event_frame.df.withColumns(made), self.step_name, made, [lon, lat], ["spatial"])


def compute_distances(event_frame: EventFrame, pois: DataFrame | str, **columns: str) -> EventFrame:
    return ComputeDistancesStep(pois, **columns).run(event_frame)


@step("grid_aggregation", "spatial")
@dataclass
class GridAggregationStep(Step):
    """Aggregates of a row's cell (and time), beside the row: ``event_count``, ``{col}_{function}``."""

    grid_col: str = "grid_id"
    agg_funcs: Sequence[str] = ("count",)
    value_cols: Sequence[str] = ()
    time_col: str | None = None

    def __post_init__(self) -> None:
        if odd := [f for f in self.agg_funcs if f not in AGGREGATES]:
            raise ValueError(f"unknown aggregates: {odd}")

    def run(self, event_frame: EventFrame) -> EventFrame:
        keys = [self.grid_col, *([self.time_col] if self.time_col else [])]
        aggs = {"event_count": F.count("*")} if "count" in self.agg_funcs else {}
        aggs |= {f"{c}_{f}": AGGREGATES[f](c) for c in self.value_cols for f in self.agg_funcs if f != "count"}
        # partial sums before the shuffle: a cell with very many rows is aggregated, not gathered
        cells = event_frame.df.groupBy(*keys).agg(*(c.alias(k) for k, c in aggs.items()))
        df = event_frame.df.drop(*aggs).join(cells, keys, "left")
        return event_frame.produced(df, self.step_name, aggs, [*keys, *self.value_cols], ["spatial"])


@step("kde", "spatial")
@dataclass
class KDEStep(Step):
    """Density around each point.

    ``kernel="box"`` (the default) counts the points, the own one included, in the
    square of the bandwidth over the area of the circle; ``uniform``, ``gaussian``
    and ``epanechnikov`` are the real kernels within the circle (gaussian: three
    bandwidths).
    """

    bandwidth: float = 500.0
    kernel: str = "box"
    output_col: str = "kde_density"

    def __post_init__(self) -> None:
        if self.bandwidth <= 0:
            raise ValueError("bandwidth must be positive")
        if self.kernel not in ("box", "uniform", "gaussian", "epanechnikov"):
            raise ValueError(f"unknown kernel: {self.kernel}")

    def run(self, event_frame: EventFrame) -> EventFrame:
        lon, lat = coordinates(event_frame)
        h = float(self.bandwidth)
        reach = 3 * h if self.kernel == "gaussian" else h
        points = event_frame.df.groupBy(F.col(lon).alias("_x"), F.col(lat).alias("_y")).agg(F.count("*").alias("_n"))
        pairs = neighbours(points, "_x", "_y", reach, reach, "_n")
        dx, dy = F.abs(F.col("_x") - F.col("_x_n")), F.abs(F.col("_y") - F.col("_y_n"))
        u = F.sqrt(dx * dx + dy * dy) / h
        weights: dict[str, tuple[Column, Column]] = {
            "box": ((dx <= h) & (dy <= h), F.lit(1 / (math.pi * h * h))),
            "uniform": (u <= 1, F.lit(1 / (math.pi * h * h))),
            "epanechnikov": (u <= 1, (1 - u * u) * (2 / (math.pi * h * h))),
            "gaussian": (u <= 3, F.exp(-u * u / 2) / (2 * math.pi * h * h)),
        }
        near, weight = weights[self.kernel]
        total = F.sum("_n_n") * F.lit(1.0) / (math.pi * h * h) if self.kernel == "box" else F.sum(F.col("_n_n") * weight)
        density = pairs.where(near).groupBy("_x", "_y").agg(total.alias(self.output_col))
        df = event_frame.df.drop(self.output_col).join(density, (F.col(lon) == F.col("_x")) & (F.col(lat) == F.col("_y")), "left").drop("_x", "_y")
        return event_frame.produced(df, self.step_name, [self.output_col], [lon, lat], ["spatial"])


#: Cells that may lie within the distance of a neighbourhood: they are enumerated.
MAX_AROUND = 10_000


def _around(mode: str, distance: float | None) -> list[tuple[int, int]]:
    """Steps in rows and columns from a cell to its neighbours on the grid, itself left out."""
    reach = 1 if mode in ("queen", "rook") else int(distance)
    if (2 * reach + 1) ** 2 > MAX_AROUND:
        raise ValueError(f"more than {MAX_AROUND} cells within a distance of {distance} cells")
    near = {"queen": lambda i, j: True, "rook": lambda i, j: not i or not j, "distance": lambda i, j: i * i + j * j <= distance * distance}[mode]
    steps = range(-reach, reach + 1)
    return [(i, j) for i in steps for j in steps if (i or j) and near(i, j)]


def _adjacent(cells: DataFrame, cell: str, value: str, around: list[tuple[int, int]]) -> DataFrame:
    """Mean, sum and number of ``value`` over the cells around; added up from the least, whatever the order of the rows."""
    shifted = cells.select(F.explode(F.array(*(F.col(cell) + (i * ROW + j) for i, j in around))).alias(cell), F.col(value).alias("_v"))
    near = shifted.where("_v is not null").groupBy(cell).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))  # at most len(around)
    total = F.aggregate("_vs", F.lit(0.0), lambda a, x: a + x)
    return near.select(cell, (total / F.size("_vs")).alias("_near_mean"), total.alias("_near_sum"), F.size("_vs").alias("_near_n"))


def _local_mean(cells: DataFrame, cell: str, value: str, mode: str, distance: float | None) -> DataFrame:
    """Adds ``_local``: the mean over a cell and its neighbours in the order of ids, or over the cells around it on the grid."""
    if mode == "sorted":
        over = Window.orderBy(cell).rowsBetween(-1, 1)  # one row a cell
        return cells.withColumn("_local", F.avg(value).over(over))
    near = _adjacent(cells, cell, value, _around(mode, distance))
    return cells.join(near, cell, "left").withColumn("_local", F.col("_near_mean")).drop("_near_mean", "_near_sum", "_near_n")


def _checked_mode(mode: str, distance: float | None) -> None:
    if mode not in ("sorted", "queen", "rook", "distance"):
        raise ValueError(f"unknown neighbourhood: {mode}")
    if (mode == "distance") != (distance is not None):
        raise ValueError("distance_threshold, in cells, goes with the mode distance")
    if distance is not None and distance < 1:
        raise ValueError("distance_threshold must be a cell at least")


def unused(step: Step, **defaults: Any) -> None:
    """Refuse parameters that an interface has and this step does nothing with, when they are set."""
    for name, value in defaults.items():
        if getattr(step, name) != value:
            raise ValueError(f"{type(step).__name__} does not support {name}={getattr(step, name)!r}")


def cell_mean(df: DataFrame, col: str) -> Column:
    """The mean as a double; of decimals the sum is exact, and so the same in any order of the rows."""
    return F.sum(col).cast("double") / F.count(col) if dict(df.dtypes)[col].startswith("decimal") else F.avg(col)


@step("spatial_lag", "spatial")
@dataclass
class SpatialLagStep(Step):
    """``{col}_spatial_lag``: means of neighbouring cells' means.

    ``mode="sorted"`` takes the three rows around each row in the order of cell,
    time and id; ``queen`` and ``rook`` take the cells around on the grid, and
    ``distance`` those up to ``distance_threshold`` cells away.
    """

    value_cols: Sequence[str]
    neighbor_col: str = "grid_id"
    weights: str = "queen"
    k: int = 4
    distance_threshold: float | None = None
    mode: str = "sorted"

    def __post_init__(self) -> None:
        _checked_mode(self.mode, self.distance_threshold)
        unused(self, weights="queen", k=4)

    def run(self, event_frame: EventFrame) -> EventFrame:
        cell, df = self.neighbor_col, event_frame.df
        made = [f"{c}_spatial_lag" for c in self.value_cols]
        means = df.groupBy(cell).agg(F.count("*").alias("_n"), *(cell_mean(df, c).alias(f"_m{i}") for i, c in enumerate(self.value_cols)))
        if self.mode == "sorted":
            by_id = Window.orderBy(cell)  # one row a cell
            for i in range(len(made)):
                means = means.withColumns({f"_p{i}": F.lag(f"_m{i}").over(by_id), f"_q{i}": F.lead(f"_m{i}").over(by_id)})
            row = Window.partitionBy(cell).orderBy(*event_order(event_frame))
            rows = df.withColumn("_r", F.row_number().over(row)).join(means.withColumnRenamed(cell, "_c"), F.col(cell).eqNullSafe(F.col("_c")), "left")

            def three(i: int) -> Column:
                before = F.when(F.col("_r") > 1, F.col(f"_m{i}")).otherwise(F.col(f"_p{i}"))
                after = F.when(F.col("_r") < F.col("_n"), F.col(f"_m{i}")).otherwise(F.col(f"_q{i}"))
                near = F.array_compact(F.array(before, F.col(f"_m{i}"), after))
                return F.try_divide(F.aggregate(near, F.lit(0.0), lambda a, x: a + x), F.size(near))

            out = rows.withColumns({name: three(i) for i, name in enumerate(made)})
        else:
            lags = means.select(cell)
            for i, name in enumerate(made):
                lags = lags.join(_local_mean(means.select(cell, f"_m{i}"), cell, f"_m{i}", self.mode, self.distance_threshold).select(cell, F.col("_local").alias(name)), cell)
            out = df.join(lags, cell, "left")
        out = out.select(*(c for c in df.columns if c not in made), *made)
        return event_frame.produced(out, self.step_name, made, [*self.value_cols, cell], ["spatial"])


@step("local_moran", "spatial")
@dataclass
class LocalMoranStep(Step):
    """Local Moran's I of the cells: ``{value}_local_moran_i`` and ``{value}_moran_cluster`` (HH, LL, HL, LH, NS)."""

    value_col: str
    spatial_unit_col: str = "grid_id"
    weights: str = "queen"
    permutations: int = 99
    mode: str = "sorted"
    distance_threshold: float | None = None

    def __post_init__(self) -> None:
        _checked_mode(self.mode, self.distance_threshold)
        unused(self, weights="queen", permutations=99)

    def run(self, event_frame: EventFrame) -> EventFrame:
        cell, v = self.spatial_unit_col, self.value_col
        cells = event_frame.df.groupBy(cell).agg(cell_mean(event_frame.df, v).alias("_m"))
        stats = cells.agg(F.avg("_m").alias("_mean"), F.stddev_samp("_m").alias("_std"))
        std = F.when(F.col("_std").isNull() | (F.col("_std") == 0), F.lit(1.0)).otherwise(F.col("_std"))
        cells = cells.join(F.broadcast(stats)).select(cell, ((F.col("_m") - F.col("_mean")) / std).alias("_z"))
        cells = _local_mean(cells, cell, "_z", self.mode, self.distance_threshold)
        z, lag = F.col("_z"), F.col("_local")
        label = F.when((z > 0) & (lag > 0), "HH").when((z < 0) & (lag < 0), "LL").when((z > 0) & (lag < 0), "HL").when((z < 0) & (lag > 0), "LH").otherwise("NS")
        made = {f"{v}_local_moran_i": z * lag, f"{v}_moran_cluster": label}
        found = cells.select(cell, *(c.alias(k) for k, c in made.items()))
        return event_frame.produced(event_frame.df.drop(*made).join(found, cell, "left"), self.step_name, made, [v, cell], ["spatial"])


@step("getis_ord", "spatial")
@dataclass
class GetisOrdStep(Step):
    """Getis-Ord Gi* of the cells' sums: ``{value}_gi_star`` and ``{value}_hotspot`` (hot, cold, not_significant).

    In the order of ids it is the sum of three cells less three means, over the
    deviation. On the grid (``queen``, ``rook``, ``distance``) it is the statistic
    itself: with w cells around, the own one included, of n in all, the sum less w
    means, over ``s * sqrt((n * w - w * w) / (n - 1))`` with the population's
    deviation s; 0 where that is 0.
    """

    value_col: str
    spatial_unit_col: str = "grid_id"
    distance_threshold: float | None = None
    mode: str = "sorted"

    def __post_init__(self) -> None:
        _checked_mode(self.mode, self.distance_threshold)

    def run(self, event_frame: EventFrame) -> EventFrame:
        cell, v = self.spatial_unit_col, self.value_col
        cells = event_frame.df.groupBy(cell).agg(F.sum(v).cast("double").alias("_m"))
        stats = F.broadcast(cells.agg(F.avg("_m").alias("_mean"), F.stddev_samp("_m").alias("_std"), F.stddev_pop("_m").alias("_pop"), F.count("_m").alias("_n")))  # one row
        if self.mode == "sorted":
            cells = cells.withColumn("_local", F.sum("_m").over(Window.orderBy(cell).rowsBetween(-1, 1))).join(stats)  # one row a cell
            std = F.when(F.col("_std").isNull() | (F.col("_std") == 0), F.lit(1.0)).otherwise(F.col("_std"))
            gi = (F.col("_local") - 3 * F.col("_mean")) / std
        else:
            near = _adjacent(cells, cell, "_m", _around(self.mode, self.distance_threshold))
            cells = cells.where(F.col("_m").isNotNull()).join(near, cell, "left").join(stats)
            w, n = F.coalesce(F.col("_near_n"), F.lit(0)) + 1, F.col("_n")
            spread = F.col("_pop") * F.sqrt((n * w - w * w) / F.greatest(n - 1, F.lit(1)))
            gi = F.when(spread > 0, (F.col("_m") + F.coalesce(F.col("_near_sum"), F.lit(0.0)) - w * F.col("_mean")) / spread).otherwise(F.lit(0.0))
        made = {f"{v}_gi_star": gi, f"{v}_hotspot": F.when(gi > 1.96, "hot").when(gi < -1.96, "cold").otherwise("not_significant")}
        found = cells.select(cell, *(c.alias(k) for k, c in made.items()))
        return event_frame.produced(event_frame.df.drop(*made).join(found, cell, "left"), self.step_name, made, [v, cell], ["spatial"])

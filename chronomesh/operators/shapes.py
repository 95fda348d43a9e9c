"""Joins of points with geometries: cells of a grid, then the exact predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.geo import distance_to, edges, inside, on_boundary
from chronomesh.plans.stage import staged

#: A geometry's box has at most about the square of this many cells.
CELLS = 8
#: So few geometries travel to every point when the nearest is asked for.
FEW = 256
PREDICATES = {
    "contains": lambda s, x, y: inside(s, x, y) & ~on_boundary(s, x, y),
    "intersects": lambda s, x, y: inside(s, x, y) | on_boundary(s, x, y),
}


def _boxed(shapes: DataFrame, wkt: str, payload: list[str]) -> DataFrame:
    sides = shapes.where(F.col(wkt).isNotNull()).select(edges(F.col(wkt)).alias("_s"), F.struct(*payload).alias("_p")).where("size(_s) > 0")
    low = lambda c: F.array_min(F.transform("_s", lambda s: F.least(s[f"{c}1"], s[f"{c}2"])))
    high = lambda c: F.array_max(F.transform("_s", lambda s: F.greatest(s[f"{c}1"], s[f"{c}2"])))
    return sides.withColumns({"_x0": low("x"), "_x1": high("x"), "_y0": low("y"), "_y1": high("y")})


def _candidates(points: DataFrame, boxed: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor((F.col(a) - reach) / cell), F.floor((F.col(b) + reach) / cell))
    cells = boxed.withColumn("_cx", F.explode(span("_x0", "_x1"))).withColumn("_cy", F.explode(span("_y0", "_y1")))
    own = points.withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
    near = F.col("_x").between(F.col("_x0") - reach, F.col("_x1") + reach) & F.col("_y").between(F.col("_y0") - reach, F.col("_y1") + reach)
    return own.join(cells, ["_cx", "_cy"]).where(near)


def locate(points: DataFrame, shapes: DataFrame, wkt: str, payload: list[str], how: str = "contains", max_distance: float | None = None) -> DataFrame:
    """For each point (_x, _y) the first geometry, by the order of its payload: columns _x, _y, _p.

    ``nearest`` looks in growing circles up to ``max_distance`` (or until all points
    have found one). Points without a geometry are absent. Each distinct point is
    looked up once.
    """
    distinct = points.where("_x is not null and _y is not null").select("_x", "_y").distinct()
    boxed = _boxed(shapes, wkt, payload)
    extent = boxed.agg(F.max(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))), F.min("_x0"), F.min("_y0"), F.max("_x1"), F.max("_y1")).first()
    if extent[0] is None:
        return distinct.limit(0).join(boxed.select("_p").limit(0))
    whole = max(extent[3] - extent[1], extent[4] - extent[2])
    cell = max(extent[0] / CELLS, whole / 4096, 1e-9)
    if how in PREDICATES:
        hits = _candidates(distinct, boxed, cell).where(PREDICATES[how](F.col("_s"), F.col("_x"), F.col("_y")))
        return hits.groupBy("_x", "_y").agg(F.min("_p").alias("_p"))
    if how != "nearest":
        raise ValueError(f"unknown join type: {how}")
    if boxed.limit(FEW + 1).count() <= FEW:
        every = boxed.agg(F.collect_list(F.struct("_s", "_p")).alias("_all"))  # one row
        best = F.array_min(F.transform("_all", lambda g: F.struct(distance_to(g["_s"], F.col("_x"), F.col("_y")).alias("_d"), g["_p"].alias("_p"))))
        near = distinct.join(F.broadcast(every)).withColumn("_best", best)
        near = near if max_distance is None else near.where(F.col("_best._d") <= max_distance)
        return near.select("_x", "_y", F.col("_best._p").alias("_p"))
    found, left = None, distinct
    reach = max_distance if max_distance is not None else max(whole / 32, 1e-9)
    far = left.agg(F.max(F.greatest(F.abs(F.col("_x")), F.abs(F.col("_y"))))).first()[0] if max_distance is None else None
    end = max_distance if max_distance is not None else 4 * (whole + (far or 0.0) + abs(extent[1]) + abs(extent[2]))
    while True:
        near = _candidates(left, boxed, max(cell, reach / 2), reach).withColumn("_d", distance_to(F.col("_s"), F.col("_x"), F.col("_y"))).where(F.col("_d") <= reach)
        hits = staged(near.groupBy("_x", "_y").agg(F.min(F.struct("_d", "_p"))["_p"].alias("_p")))
        found = hits if found is None else found.union(hits)
        if reach >= end:
            return found
        left = left.join(hits, ["_x", "_y"], "left_anti")
        if left.isEmpty():
            return found
        reach = min(reach * 4, end)

"""Map projections, distances and plane geometry as expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Metres of a degree of latitude, rounded down.
METRES_PER_DEGREE = 111_194.0


class CRS(str, Enum):
    WGS84 = "EPSG:4326"
    WEB_MERCATOR = "EPSG:3857"
    ILLINOIS_EAST = "EPSG:26971"
    UTM_16N = "EPSG:32616"
    CALIFORNIA_6 = "EPSG:26946"


@dataclass(frozen=True)
class _Ellipsoid:
    a: float
    inverse_f: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_f

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))


WGS84, GRS80 = _Ellipsoid(6378137.0, 298.257223563), _Ellipsoid(6378137.0, 298.257222101)


def _mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = WGS84.a
    return F.radians(lon) * r, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


class _TransverseMercator:
    """Krueger's series to the fourth power of n."""

    def __init__(self, lat0: float, lon0: float, k0: float, east: float, north: float, shape: _Ellipsoid):
        n = shape.f / (2 - shape.f)
        self.k = k0 * shape.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
        )
        self.lon0, self.east, self.e = lon0, east, shape.e
        s = math.sin(math.radians(lat0))
        xi = math.atan(math.sinh(math.atanh(s) - self.e * math.atanh(self.e * s)))
        self.north = north - self.k * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self.alpha, 1)))

    def __call__(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s, d = F.sin(F.radians(lat)), F.radians(lon - F.lit(self.lon0))
        t = F.sinh(F.atanh(s) - self.e * F.atanh(self.e * s))
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(self.alpha, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return x * self.k + self.east, y * self.k + self.north


class _LambertConic:
    """Conformal, with two standard parallels."""

    def __init__(self, lat0: float, lon0: float, sp1: float, sp2: float, east: float, north: float, shape: _Ellipsoid):
        self.e, self.lon0, self.east = shape.e, lon0, east

        def m(p: float) -> float:
            return math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2)

        def t(p: float) -> float:
            s = self.e * math.sin(p)
            return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

        p0, p1, p2 = map(math.radians, (lat0, sp1, sp2))
        self.n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        self.scale = shape.a * m(p1) / (self.n * t(p1) ** self.n)
        self.north = north + self.scale * t(p0) ** self.n

    def __call__(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        p = F.radians(lat)
        s = self.e * F.sin(p)
        t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        rho, angle = F.pow(t, F.lit(self.n)) * self.scale, F.radians(lon - F.lit(self.lon0)) * self.n
        return rho * F.sin(angle) + self.east, F.lit(self.north) - rho * F.cos(angle)


#: Projections from longitude and latitude; parameters from the public EPSG registry.
PROJECTIONS = {
    CRS.WEB_MERCATOR: _mercator,
    CRS.ILLINOIS_EAST: _TransverseMercator(36 + 40 / 60, -(88 + 20 / 60), 0.999975, 300000.0, 0.0, GRS80),
    CRS.UTM_16N: _TransverseMercator(0.0, -87.0, 0.9996, 500000.0, 0.0, WGS84),
    CRS.CALIFORNIA_6: _LambertConic(32 + 10 / 60, -(116 + 15 / 60), 33 + 53 / 60, 32 + 47 / 60, 2000000.0, 500000.0, GRS80),
}


def project(lon: Column, lat: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates in another system; by formula where it is known, else through pyproj if that is installed."""
    if source == CRS.WGS84 and target in list(PROJECTIONS):
        return PROJECTIONS[CRS(target)](lon, lat)
    try:
        import pyproj
    except ImportError:
        raise ValueError(f"no formula from {source} to {target}, and pyproj is not installed") from None
    import pandas as pd

    pyproj.Transformer.from_crs(source, target, always_xy=True)  # fails here, not in a task

    @F.pandas_udf("x double, y double")
    def by_library(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = pyproj.Transformer.from_crs(source, target, always_xy=True).transform(a.values, b.values)
        return pd.DataFrame({"x": x, "y": y})

    both = by_library(lon, lat)
    return both["x"], both["y"]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h))) * (2 * EARTH_RADIUS_M)


def plane_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


_NUMBER = r"[-+0-9.eE]+"


def edges(wkt: Column) -> Column:
    """The sides of all rings of a WKT geometry, as structs x1, y1, x2, y2; a point is a side of length 0."""

    def ring(text: Column) -> Column:
        points = F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.transform(F.split(p, r"\s+"), lambda v: v.cast("double")))
        ahead = F.when(F.size(points) > 1, F.slice(points, F.lit(2), F.size(points) - 1)).otherwise(points)
        behind = F.when(F.size(points) > 1, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
        return F.zip_with(behind, ahead, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))

    return F.flatten(F.transform(F.regexp_extract_all(wkt, F.lit(r"\(\s*(" + _NUMBER + r"\s[^()]*)\)"), F.lit(1)), ring))


def inside(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings: holes and several parts are taken care of."""
    crossing = lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * F.coalesce(F.try_divide(y - s["y1"], s["y2"] - s["y1"]), F.lit(0.0)) + s["x1"])
    return F.size(F.filter(sides, crossing)) % 2 == 1


def on_boundary(sides: Column, x: Column, y: Column) -> Column:
    def on(s: Column) -> Column:
        cross = (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
        return (cross == 0) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))

    return F.exists(sides, on)


def distance_to(sides: Column, x: Column, y: Column) -> Column:
    """Plane distance to a geometry: 0 inside, else to its nearest side."""

    def to(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = F.coalesce(F.try_divide((x - s["x1"]) * dx + (y - s["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return plane_distance(x, y, s["x1"] + t * dx, s["y1"] + t * dy)

    return F.when(inside(sides, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(sides, to)))


def validate_bounds(bounds: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """(minx, miny, maxx, maxy), each minimum below its maximum."""
    if len(bounds) != 4 or bounds[0] >= bounds[2] or bounds[1] >= bounds[3]:
        raise ValueError(f"not bounds: {bounds}")
    return bounds

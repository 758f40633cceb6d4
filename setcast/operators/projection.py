"""Transverse Mercator grids as native expressions, both ways, by series in the third flattening to its fourth power."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """An ellipsoid (axis a, inverse flattening) and a grid on it: central meridian and parallel in degrees, scale, false origin in metres."""

    a: float = 6378137.0
    inverse: float = 298.257222101
    lon0: float = 9.0
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0

    @property
    def n(self) -> float:
        return 1 / (2 * self.inverse - 1)

    @property
    def e(self) -> float:
        return math.sqrt((2 - 1 / self.inverse) / self.inverse)

    @property
    def radius(self) -> float:
        n = self.n
        return self.scale * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _series(self, rows: tuple[tuple[float, ...], ...]) -> list[float]:
        """Row j has the factors of n**j and higher powers."""
        return [sum(c * self.n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]

    # Factors of the series, from the conformal sphere to the grid, back, and from conformal to geographic latitudes.
    @property
    def alpha(self) -> list[float]:
        return self._series(((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,)))

    @property
    def beta(self) -> list[float]:
        return self._series(((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,)))

    @property
    def delta(self) -> list[float]:
        return self._series(((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,)))

    @property
    def origin(self) -> float:
        """The northing of the central parallel before the false origin."""
        s = math.sin(math.radians(self.lat0))
        t = math.sinh(math.atanh(s) - self.e * math.atanh(self.e * s))
        xi = math.atan(t)
        return self.radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self.alpha, 1)))


def utm(zone: int, **ellipsoid: float) -> Grid:
    """A zone of the northern hemisphere, on GRS80 unless told otherwise."""
    return Grid(lon0=zone * 6.0 - 183.0, **ellipsoid)


# The coordinate systems of the reference data, by their public codes.
SYSTEMS = {25832: utm(32), 25833: utm(33), 32632: utm(32, inverse=298.257223563), 32633: utm(33, inverse=298.257223563)}


def _sum(terms) -> Column:
    return sum(terms, F.lit(0.0))


def _stepwise(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    """df with the columns of each step, which use those of the one before: each is computed once."""
    for step in steps:
        df = df.withColumns(step)
    return df


def with_grid(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """df with easting and northing of its degrees."""
    t, xi, eta, s = (F.col(c) for c in ("_t", "_xi", "_eta", "_s"))
    east = eta + _sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(grid.alpha, 1))
    north = xi + _sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(grid.alpha, 1))
    steps = [
        {"_s": F.sin(F.radians(F.col(lat))), "_turn": F.radians(F.col(lon) - grid.lon0)},
        {"_t": F.sinh(F.atanh(s) - grid.e * F.atanh(grid.e * s))},
        {"_xi": F.atan2(t, F.cos("_turn")), "_eta": F.atanh(F.sin("_turn") / F.sqrt(1 + t * t))},
        {x: grid.east + grid.radius * east, y: grid.north - grid.origin + grid.radius * north},
    ]
    return _stepwise(df, steps).drop("_s", "_turn", "_t", "_xi", "_eta")


def with_degrees(df: DataFrame, grid: Grid, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with longitude and latitude of its grid coordinates."""
    p, q, xi, eta, chi = (F.col(c) for c in ("_p", "_q", "_xi", "_eta", "_chi"))
    steps = [
        {"_p": (F.col(y) - grid.north + grid.origin) / grid.radius, "_q": (F.col(x) - grid.east) / grid.radius},
        {"_xi": p - _sum(b * F.sin(2 * j * p) * F.cosh(2 * j * q) for j, b in enumerate(grid.beta, 1)), "_eta": q - _sum(b * F.cos(2 * j * p) * F.sinh(2 * j * q) for j, b in enumerate(grid.beta, 1))},
        {"_chi": F.asin(F.sin(xi) / F.cosh(eta)), lon: grid.lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))},
        {lat: F.degrees(chi + _sum(d * F.sin(2 * j * chi) for j, d in enumerate(grid.delta, 1)))},
    ]
    return _stepwise(df, steps).drop("_p", "_q", "_xi", "_eta", "_chi")


def reprojected(points: DataFrame, source: int | Grid, target: int | Grid, x: str = "x", y: str = "y") -> DataFrame:
    """points with x and y in another system: native expressions, no shuffle. Null coordinates stay null."""
    source, target = (SYSTEMS[g] if isinstance(g, int) else g for g in (source, target))
    there = with_degrees(points, source, x, y, "_lon", "_lat")
    return with_grid(there, target, "_lon", "_lat", x, y).select(*points.columns)


def tiled(points: DataFrame, size: float = 10_000.0, x: str = "x", y: str = "y") -> DataFrame:
    """points with tile_x and tile_y: tiles of a square grid, by default of 10 km."""
    return points.withColumn("tile_x", F.floor(F.col(x) / size)).withColumn("tile_y", F.floor(F.col(y) / size))

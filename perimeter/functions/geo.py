"""Map projections and grid addressing as Column expressions.

Closed forms (Snyder 1987) on the GRS80 ellipsoid for the conic equal-area grid and on the
weather model's sphere for the conformal grid, so every projection stays inside codegen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Conterminous-US Albers equal area (EPSG:5070)."""

    a: float = 6378137.0
    inv_f: float = 298.257222101
    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0

    @property
    def e2(self) -> float:
        f = 1 / self.inv_f
        return 2 * f - f * f

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    def q(self, lat: float) -> float:
        s, e = math.sin(math.radians(lat)), self.e
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - self.e2 * s * s)

    @property
    def n(self) -> float:
        return (self.m(self.lat1) ** 2 - self.m(self.lat2) ** 2) / (self.q(self.lat2) - self.q(self.lat1))

    @property
    def c(self) -> float:
        return self.m(self.lat1) ** 2 + self.n * self.q(self.lat1)

    @property
    def rho0(self) -> float:
        return self.a * math.sqrt(self.c - self.n * self.q(self.lat0)) / self.n


@dataclass(frozen=True)
class Lambert:
    """Spherical Lambert conformal conic with one standard parallel (the weather grid)."""

    r: float = 6371229.0
    lat0: float = 38.5
    lon0: float = -97.5

    @property
    def n(self) -> float:
        return math.sin(math.radians(self.lat0))

    @property
    def f(self) -> float:
        p = math.radians(self.lat0)
        return math.cos(p) * math.tan(math.pi / 4 + p / 2) ** self.n / self.n

    @property
    def rho0(self) -> float:
        return self.r * self.f / math.tan(math.pi / 4 + math.radians(self.lat0) / 2) ** self.n


ALBERS, LAMBERT = Albers(), Lambert()


def lonlat_to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = ALBERS
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * p.e2) - F.log((1 - s * p.e) / (1 + s * p.e)) / (2 * p.e)) * (1 - p.e2)
    rho = F.sqrt(p.c - q * p.n) * (p.a / p.n)
    theta = F.radians(lon - p.lon0) * p.n
    return rho * F.sin(theta), p.rho0 - rho * F.cos(theta)


def albers_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    p = ALBERS
    dy = p.rho0 - y
    rho2 = x * x + dy * dy
    q = (p.c - rho2 * (p.n * p.n / (p.a * p.a))) / p.n
    beta = F.asin(q / p.q(90.0))
    e2, e4, e6 = p.e2, p.e2**2, p.e2**3
    lat = (beta
           + F.sin(beta * 2) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)
           + F.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780)
           + F.sin(beta * 6) * (761 * e6 / 45360))
    return F.degrees(F.atan2(x, dy) / p.n) + p.lon0, F.degrees(lat)


def lonlat_to_lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = LAMBERT
    rho = F.lit(p.r * p.f) / F.pow(F.tan(F.radians(lat) / 2 + math.pi / 4), F.lit(p.n))
    theta = F.radians(lon - p.lon0) * p.n
    return rho * F.sin(theta), p.rho0 - rho * F.cos(theta)


def lambert_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    p = LAMBERT
    dy = p.rho0 - y
    rho = F.sqrt(x * x + dy * dy)
    lat = F.atan(F.pow(F.lit(p.r * p.f) / rho, F.lit(1 / p.n))) * 2 - math.pi / 2
    return F.degrees(F.atan2(x, dy) / p.n) + p.lon0, F.degrees(lat)


def fold_longitude(lon: Column) -> Column:
    """0..360 longitudes to -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def fold_latitude(lat: Column) -> Column:
    """Latitudes beyond a pole folded back to -90..90, which is where the Albers formulas place them too."""
    return F.when(F.abs(lat) <= 90.0, lat).otherwise(F.degrees(F.asin(F.sin(F.radians(lat)))))


def cell_of(x: Column, y: Column, x0: Column, y1: Column, res: float) -> tuple[Column, Column]:
    """(row, col) of the cell holding a point on a north-up grid with top-left (x0, y1)."""
    return F.floor((y1 - y) / res).cast("int"), F.floor((x - x0) / res).cast("int")


def centre_of(row: Column, col: Column, x0: Column, y1: Column, res: float) -> tuple[Column, Column]:
    """(x, y) of a cell's centre."""
    return x0 + (col + 0.5) * res, y1 - (row + 0.5) * res

"""Transverse Mercator to and from longitude and latitude, as column expressions (Krueger's series to the fourth order)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


@dataclass(frozen=True)
class TransverseMercator:
    """Central meridian in degrees, scale on it, false easting and northing, ellipsoid."""

    meridian: float
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    axis: float = 6_378_137.0
    flattening: float = 1 / 298.257223563

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        n = self.n
        return self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def series(self) -> tuple[list[float], list[float], list[float]]:
        n = self.n
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return alpha, beta, delta


def projection(crs: str) -> TransverseMercator | None:
    """EPSG:326xx (UTM north), EPSG:4547 (three-degree zone at 114 E on its own ellipsoid), or None for EPSG:4326."""
    code = int(crs.upper().removeprefix("EPSG:"))
    if code == 4326:
        return None
    if 32601 <= code <= 32660:
        return TransverseMercator(6 * (code - 32600) - 183)
    if code == 4547:
        return TransverseMercator(114.0, 1.0, flattening=1 / 298.257222101)
    raise ValueError(f"no projection for {crs}")


def _sinh(x: Column) -> Column:
    return (F.exp(x) - F.exp(-x)) / 2


def _cosh(x: Column) -> Column:
    return (F.exp(x) + F.exp(-x)) / 2


def _atanh(x: Column) -> Column:
    return F.ln((1 + x) / (1 - x)) / 2


def forward(lon: Column, lat: Column, tm: TransverseMercator) -> tuple[Column, Column]:
    alpha, _, _ = tm.series()
    e = 2 * math.sqrt(tm.n) / (1 + tm.n)
    phi, lam = F.radians(lat), F.radians(lon - tm.meridian)
    t = _sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * _sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * _cosh(2 * j * eta)
    return tm.easting + tm.scale * tm.radius * x, tm.northing + tm.scale * tm.radius * y


def inverse(x: Column, y: Column, tm: TransverseMercator) -> tuple[Column, Column]:
    _, beta, delta = tm.series()
    xi, eta = (y - tm.northing) / (tm.scale * tm.radius), (x - tm.easting) / (tm.scale * tm.radius)
    u, v = xi, eta
    for j, b in enumerate(beta, 1):
        u = u - b * F.sin(2 * j * xi) * _cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * _sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / _cosh(v))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return tm.meridian + F.degrees(F.atan2(_sinh(v), F.cos(u))), F.degrees(lat)


def transform_point(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Nothing is computed where the two systems are the same."""
    if source.upper() == target.upper():
        return x, y
    a, b = projection(source), projection(target)
    lon, lat = (x, y) if a is None else inverse(x, y, a)
    return (lon, lat) if b is None else forward(lon, lat, b)


def transform_parts(parts: Column, source: str, target: str) -> Column:
    move = lambda p: g.point(*transform_point(p.x, p.y, source, target))
    return F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, move)))

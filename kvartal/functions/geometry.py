"""Plane and map geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS84 and of the zone's projection.
_A, _F = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST = 0.9996, 500_000.0


def _series() -> tuple[float, float, tuple[float, float, float]]:
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return n, radius, (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)


def project(lon: Column, lat: Column, meridian: float = 39.0) -> tuple[Column, Column]:
    """Easting and northing in metres by the Krüger series of the transverse Mercator projection (zone 37: 39 degrees)."""
    n, radius, alpha = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return SCALE * radius * x + FALSE_EAST, SCALE * radius * y


def area2(points: Column) -> Column:
    """Twice the signed area of a ring, an array of structs (x, y): the shoelace sum."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, nxt, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0).cast("long"), lambda a, v: a + v)


def cells_on_segment(x1: Column, y1: Column, x2: Column, y2: Column, size: int) -> Column:
    """Cells that a segment passes through, in order, as structs (ix, iy).

    The segment is cut wherever it meets a grid line, and each part's middle tells its cell;
    all positions are kept as fractions of the segment's length.
    """

    def lines(a: Column, b: Column) -> Column:
        lo, hi = F.floor(F.least(a, b) / F.lit(size)) + 1, F.ceil(F.greatest(a, b) / F.lit(size)) - 1
        cuts = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(cuts, lambda g: (g * size - a) / (b - a).cast("double"))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), lines(x1, x2), lines(y1, y2))))
    mid = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: (a + b) / 2)
    return F.transform(mid, lambda m: F.struct(F.floor((x1 + (x2 - x1) * m) / size).alias("ix"), F.floor((y1 + (y2 - y1) * m) / size).alias("iy")))

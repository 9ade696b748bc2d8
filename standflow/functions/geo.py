"""Map projection and cell binning as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the European equal-area projection.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
LAT_0, LON_0 = 52.0, 10.0
FALSE_EASTING, FALSE_NORTHING = 4321000.0, 3210000.0


def laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area coordinates in metres (Snyder 1987, ellipsoidal form)."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def q_of(sin_phi, log):
        return (1 - e2) * (
            sin_phi / (1 - e2 * sin_phi * sin_phi)
            - log((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e)
        )

    phi_0 = math.radians(LAT_0)
    q_pole = q_of(1.0, math.log)
    beta_0 = math.asin(q_of(math.sin(phi_0), math.log) / q_pole)
    radius = SEMI_MAJOR * math.sqrt(q_pole / 2)
    m_0 = math.cos(phi_0) / math.sqrt(1 - e2 * math.sin(phi_0) ** 2)
    d = SEMI_MAJOR * m_0 / (radius * math.cos(beta_0))

    sin_beta = q_of(F.sin(F.radians(lat)), F.log) / F.lit(q_pole)
    cos_beta = F.sqrt(F.lit(1.0) - sin_beta * sin_beta)
    dlon = F.radians(lon - F.lit(LON_0))
    b = F.lit(radius) * F.sqrt(
        F.lit(2.0)
        / (1 + math.sin(beta_0) * sin_beta + math.cos(beta_0) * cos_beta * F.cos(dlon))
    )
    x = b * d * cos_beta * F.sin(dlon) + FALSE_EASTING
    y = b / d * (math.cos(beta_0) * sin_beta - math.sin(beta_0) * cos_beta * F.cos(dlon))
    return x, y + FALSE_NORTHING


def cell_width_of(kind: str, cell_width: float | None, cell_area: float | None) -> float:
    """Distance between opposite sides of a cell, from its width or its area."""
    if kind not in ("square", "hexagonal"):
        raise ValueError("type must be either 'square' or 'hexagonal'")
    if cell_width is not None:
        return float(cell_width)
    if cell_area is None:
        raise ValueError("give cell_width or cell_area")
    return math.sqrt(cell_area) if kind == "square" else math.sqrt(2 * cell_area / math.sqrt(3))


def square_index(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    return F.floor(x / width).cast("bigint"), F.floor(y / width).cast("bigint")


def hexagon_index(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon holding a point; centres are `width` apart along a row and every
    second row is shifted by half a width. The three cube coordinates are rounded and the one that
    moved furthest is recomputed from the other two."""
    r = y / (width * math.sqrt(3) / 2)
    q = x / width - r / 2
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_out = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r_out = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q_out.cast("bigint"), r_out.cast("bigint")

"""Earth frames as Column expressions: geodetic, earth-fixed, local and the Swiss oblique Mercator grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rotations import enu_ned, mat_mul, mat_vec, ned_to_ecef, sub, transpose

# Ellipsoids (semi-major axis, flattening).
WGS84 = (6378137.0, 1 / 298.257223563)
BESSEL = (6377397.155, 1 / 299.1528128)
# The Swiss datum shift (earth-fixed, from global to local) and the grid's origin.
SWISS_SHIFT = (-674.374, -15.056, -405.346)
SWISS_LAT, SWISS_LON = math.radians(46 + 57 / 60 + 8.66 / 3600), math.radians(7 + 26 / 60 + 22.50 / 3600)
SWISS_EAST, SWISS_NORTH = 2_600_000.0, 1_200_000.0


def geodetic_to_ecef(lat, lon, alt, ellipsoid=WGS84) -> Sequence[Column]:
    """Radians and metres to earth-fixed coordinates."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return [(n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + alt) * F.sin(lat)]


def ecef_to_geodetic(x, y, z, ellipsoid=WGS84) -> Sequence[Column]:
    """Closed form (Bowring), good to well below a micrometre within 10 km of the ellipsoid."""
    a, f = ellipsoid
    b, e2 = a * (1 - f), f * (2 - f)
    up2 = e2 / (1 - e2)
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(z * a, p * b)
    for _ in range(2):
        lat = F.atan2(z + up2 * b * F.pow(F.sin(beta), 3), p - e2 * a * F.pow(F.cos(beta), 3))
        beta = F.atan2((1 - f) * F.sin(lat), F.cos(lat))
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    alt = p * F.cos(lat) + z * F.sin(lat) - a * a / n
    return [lat, F.atan2(y, x), alt]


def swiss_projection(lat, lon) -> Sequence[Column]:
    """Bessel latitude and longitude (radians) to east and north."""
    a, f = BESSEL
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    s0 = math.sin(SWISS_LAT)
    radius = a * math.sqrt(1 - e2) / (1 - e2 * s0 * s0)
    alpha = math.sqrt(1 + e2 / (1 - e2) * math.cos(SWISS_LAT) ** 4)
    b0 = math.asin(s0 / alpha)
    k = math.log(math.tan(math.pi / 4 + b0 / 2)) - alpha * math.log(math.tan(math.pi / 4 + SWISS_LAT / 2)) + alpha * e / 2 * math.log((1 + e * s0) / (1 - e * s0))
    sin = F.sin(lat)
    s = alpha * F.log(F.tan(math.pi / 4 + lat / 2)) - alpha * e / 2 * F.log((1 + e * sin) / (1 - e * sin)) + k
    sphere = 2 * (F.atan(F.exp(s)) - math.pi / 4)
    turn = alpha * (lon - SWISS_LON)
    l_ = F.atan2(F.sin(turn), math.sin(b0) * F.tan(sphere) + math.cos(b0) * F.cos(turn))
    b_ = F.asin(math.cos(b0) * F.sin(sphere) - math.sin(b0) * F.cos(sphere) * F.cos(turn))
    return [SWISS_EAST + radius * l_, SWISS_NORTH + radius / 2 * F.log((1 + F.sin(b_)) / (1 - F.sin(b_)))]


def with_swiss(df: DataFrame, xyz: tuple[str, str, str], out: tuple[str, str, str], height: str = "local") -> DataFrame:
    """Adds grid coordinates of global earth-fixed columns.  height: `local` is above the local ellipsoid, `global` above
    the global one.

    Goes by steps: an expression that names its parts several times grows with each level, columns don't."""
    kept = [c for c in df.columns if c not in out]
    rows = df.withColumns({f"_s{i}": F.col(c) + d for i, (c, d) in enumerate(zip(xyz, SWISS_SHIFT, strict=True))})
    rows = _with_geodetic(rows, ("_s0", "_s1", "_s2"), ("_lat", "_lon", "_h"), BESSEL)
    if height == "global":
        rows = _with_geodetic(rows.drop("_h"), xyz, ("_glat", "_glon", "_h"), WGS84)
    e, n = swiss_projection(F.col("_lat"), F.col("_lon"))
    return rows.select(*kept, e.alias(out[0]), n.alias(out[1]), F.col("_h").alias(out[2]))


def _with_geodetic(df: DataFrame, xyz: tuple[str, str, str], out: tuple[str, str, str], ellipsoid) -> DataFrame:
    a, f = ellipsoid
    b, e2 = a * (1 - f), f * (2 - f)
    x, y, z = map(F.col, xyz)
    rows = df.withColumn("_p", F.sqrt(x * x + y * y)).withColumn("_beta", F.atan2(z * a, F.col("_p") * b))
    for last in (False, True):
        lat = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin("_beta"), 3), F.col("_p") - e2 * a * F.pow(F.cos("_beta"), 3))
        rows = rows.withColumn(out[0], lat)
        if not last:
            rows = rows.withColumn("_beta", F.atan2((1 - f) * F.sin(out[0]), F.cos(out[0])))
    alt = F.col("_p") * F.cos(out[0]) + z * F.sin(out[0]) - a * F.sqrt(1 - e2 * F.sin(out[0]) * F.sin(out[0]))
    return rows.withColumns({out[1]: F.atan2(y, x), out[2]: alt}).drop("_p", "_beta")


def ecef_to_enu(point: Sequence, origin: Sequence, lat, lon) -> Sequence[Column]:
    """East, north, up about an earth-fixed origin at the given latitude and longitude."""
    return mat_vec(transpose(mat_mul(ned_to_ecef(lat, lon), enu_ned())), sub(point, origin))

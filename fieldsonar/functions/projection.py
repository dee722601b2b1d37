"""WGS84 longitude and latitude to the British National Grid and back, as columns.

Published constants: WGS84 and Airy 1830 ellipsoids, the seven-parameter OSGB36 to WGS84 transformation (position
vector) and the grid's transverse Mercator, by a Krueger series in the third flattening. Loops are unrolled into successive projections that
name what is used again, so each value is computed once and all stays in one stage of generated code. Accuracy is that
of the seven-parameter transformation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WGS84_A, WGS84_RF = 6378137.0, 298.257223563
AIRY_A, AIRY_RF = 6377563.396, 299.3249646
SHIFT_M = (446.448, -125.157, 542.06)
TURN_S = (0.15, 0.247, 0.842)
SCALE_PPM = -20.489
F0, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0

_RX, _RY, _RZ = (math.radians(s / 3600) for s in TURN_S)
_SCALE = 1 + SCALE_PPM * 1e-6


def _e2(rf: float) -> float:
    return (2 - 1 / rf) / rf


def _ecef(df: DataFrame, lon: str, lat: str, a: float, rf: float) -> DataFrame:
    """Adds __x, __y, __z of points in radians on the ellipsoid."""
    e2, s = _e2(rf), F.sin(F.col(lat))
    df = df.withColumn("__n", F.lit(a) / F.sqrt(1 - e2 * s * s))
    n, c = F.col("__n"), F.cos(F.col(lat))
    return df.withColumns({"__x": n * c * F.cos(F.col(lon)), "__y": n * c * F.sin(F.col(lon)), "__z": n * (1 - e2) * s})


def _geodetic(df: DataFrame, a: float, rf: float, rounds: int = 5) -> DataFrame:
    """Adds __lon, __lat in radians of __x, __y, __z; the iteration has converged to double precision after five rounds."""
    e2 = _e2(rf)
    x, y, z, p = (F.col(c) for c in ("__x", "__y", "__z", "__p"))
    df = df.withColumn("__p", F.sqrt(x * x + y * y)).withColumn("__lat", F.atan2(z, p * (1 - e2)))
    for _ in range(rounds):
        s = F.sin(F.col("__lat"))
        df = df.withColumn("__n", F.lit(a) / F.sqrt(1 - e2 * s * s)).withColumn("__lat", F.atan2(z + e2 * F.col("__n") * s, p))
    return df.withColumn("__lon", F.atan2(y, x))


def _to_osgb(df: DataFrame) -> DataFrame:
    """The transposed rotation, not its inverse: forward and back differ by about 1e-8 degrees."""
    u, v, w = (F.col(c) - t for c, t in zip(("__x", "__y", "__z"), SHIFT_M))
    return df.withColumns({"__x": (u + _RZ * v - _RY * w) / _SCALE, "__y": (-_RZ * u + v + _RX * w) / _SCALE, "__z": (_RY * u - _RX * v + w) / _SCALE})


def _to_wgs(df: DataFrame) -> DataFrame:
    x, y, z = (F.col(c) for c in ("__x", "__y", "__z"))
    return df.withColumns({"__x": SHIFT_M[0] + _SCALE * (x - _RZ * y + _RY * z), "__y": SHIFT_M[1] + _SCALE * (_RZ * x + y - _RX * z), "__z": SHIFT_M[2] + _SCALE * (-_RY * x + _RX * y + z)})


_N = 1 / (2 * AIRY_RF - 1)
#: Rectifying radius, and the series' coefficients from geographic to grid and back.
_RADIUS = AIRY_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4 - 127 / 288 * _N**5,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4 + 281 / 630 * _N**5,
    61 / 240 * _N**3 - 103 / 140 * _N**4 + 15061 / 26880 * _N**5,
    49561 / 161280 * _N**4 - 179 / 168 * _N**5,
    34729 / 80640 * _N**5,
)
_BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4 - 81 / 512 * _N**5,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4 + 46 / 105 * _N**5,
    17 / 480 * _N**3 - 37 / 840 * _N**4 - 209 / 4480 * _N**5,
    4397 / 161280 * _N**4 - 11 / 504 * _N**5,
    4583 / 161280 * _N**5,
)
_E = math.sqrt(_e2(AIRY_RF))


def _conformal(phi: float) -> float:
    s = math.sin(phi)
    return math.atan(math.sinh(math.atanh(s) - _E * math.atanh(_E * s)))


def _northing_of(phi: float) -> float:
    x = _conformal(phi)
    return _RADIUS * (x + sum(a * math.sin(2 * (i + 1) * x) for i, a in enumerate(_ALPHA)))


_TRUE_NORTH = NORTH0 - F0 * _northing_of(math.radians(LAT0))


def _without_steps(df: DataFrame, own: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in own])


def with_grid(df: DataFrame, lon_deg: Column, lat_deg: Column, easting: str = "easting_m", northing: str = "northing_m") -> DataFrame:
    """The table with easting and northing in metres of a longitude and latitude."""
    own = [c for c in df.columns if c not in (easting, northing)]
    out = df.withColumns({"__lon": F.radians(lon_deg), "__lat": F.radians(lat_deg)})
    out = _geodetic(_to_osgb(_ecef(out, "__lon", "__lat", WGS84_A, WGS84_RF)), AIRY_A, AIRY_RF)
    out = out.withColumn("__s", F.sin("__lat")).withColumn("__t", F.sinh(F.atanh("__s") - _E * F.atanh(_E * F.col("__s"))))
    t, d = F.col("__t"), F.col("__lon") - math.radians(LON0)
    out = out.withColumns({"__xi": F.atan2(t, F.cos(d)), "__eta": F.atanh(F.sin(d) / F.sqrt(1 + t * t))})
    xi, eta = F.col("__xi"), F.col("__eta")
    north, east = xi, eta
    for i, a in enumerate(_ALPHA):
        k = 2 * (i + 1)
        north = north + a * F.sin(k * xi) * F.cosh(k * eta)
        east = east + a * F.cos(k * xi) * F.sinh(k * eta)
    out = out.withColumns({easting: EAST0 + F0 * _RADIUS * east, northing: _TRUE_NORTH + F0 * _RADIUS * north})
    return _without_steps(out, [*own, easting, northing])


def with_lon_lat(df: DataFrame, easting: Column, northing: Column, lon: str = "lon_deg", lat: str = "lat_deg") -> DataFrame:
    """The table with longitude and latitude in degrees of a grid position."""
    own = [c for c in df.columns if c not in (lon, lat)]
    out = df.withColumns({"__xi": (northing - _TRUE_NORTH) / (F0 * _RADIUS), "__eta": (easting - EAST0) / (F0 * _RADIUS)})
    xi, eta = F.col("__xi"), F.col("__eta")
    u, v = xi, eta
    for i, b in enumerate(_BETA):
        k = 2 * (i + 1)
        u = u - b * F.sin(k * xi) * F.cosh(k * eta)
        v = v - b * F.cos(k * xi) * F.sinh(k * eta)
    out = out.withColumns({"__u": u, "__v": v})
    u, v = F.col("__u"), F.col("__v")
    # the conformal latitude's tangent, back to that of the latitude
    out = out.withColumn("__psi", F.asinh(F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u)))).withColumn("__s", F.tanh("__psi"))
    for _ in range(6):
        out = out.withColumn("__s", F.tanh(F.col("__psi") + _E * F.atanh(_E * F.col("__s"))))
    out = out.withColumns({"__lat": F.asin("__s"), "__lon": math.radians(LON0) + F.atan2(F.sinh(v), F.cos(u))})
    out = _geodetic(_to_wgs(_ecef(out, "__lon", "__lat", AIRY_A, AIRY_RF)), WGS84_A, WGS84_RF)
    out = out.withColumns({lon: F.degrees("__lon"), lat: F.degrees("__lat")})
    return _without_steps(out, [*own, lon, lat])

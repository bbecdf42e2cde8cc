"""Projections and lines that need iteration: numpy in Arrow batches.

The equal-area projection of raster tiles is Mollweide on a sphere with the WGS84 equatorial radius.
Lengths are geodesics on the WGS84 ellipsoid by Vincenty's inverse formula.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

A = 6_378_137.0
FLATTENING = 1 / 298.257223563


def mollweide(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres from degrees."""
    phi = np.radians(lat)
    theta = phi.copy()
    for _ in range(100):
        slope = 2 + 2 * np.cos(2 * theta)
        step = np.where(slope > 1e-12, (2 * theta + np.sin(2 * theta) - np.pi * np.sin(phi)) / np.where(slope > 1e-12, slope, 1), 0)
        theta = theta - step
        if np.abs(step).max(initial=0) < 1e-13:
            break
    theta = np.where(np.abs(np.abs(lat) - 90) < 1e-12, np.sign(lat) * np.pi / 2, theta)
    return 2 * np.sqrt(2) / np.pi * A * np.radians(lon) * np.cos(theta), np.sqrt(2) * A * np.sin(theta)


def from_mollweide(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees from metres; outside the ellipse longitudes leave their range."""
    theta = np.arcsin(np.clip(y / (np.sqrt(2) * A), -1, 1))
    lat = np.degrees(np.arcsin(np.clip((2 * theta + np.sin(2 * theta)) / np.pi, -1, 1)))
    width = 2 * np.sqrt(2) * A * np.cos(theta)
    return lat, np.degrees(np.where(width > 1e-6, np.pi * x / np.where(width > 1e-6, width, 1), 0))


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_LATLON = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@F.pandas_udf(_XY)
def to_equal_area(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    x, y = mollweide(lat.to_numpy(float), lon.to_numpy(float))
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(_LATLON)
def from_equal_area(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    lat, lon = from_mollweide(x.to_numpy(float), y.to_numpy(float))
    return pd.DataFrame({"lat": lat, "lon": lon})


def geodesic_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres between points; nearly antipodal ones, for which the formula does not converge, by the last step."""
    b = A * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(p))) for p in (lat1, lat2))
    span = np.radians(lon2 - lon1)
    lam = span.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    for _ in range(200):
        sin_sigma = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cos_sigma = s1 * s2 + c1 * c2 * np.cos(lam)
        sigma = np.arctan2(sin_sigma, cos_sigma)
        sin_alpha = np.where(sin_sigma > 0, c1 * c2 * np.sin(lam) / np.where(sin_sigma > 0, sin_sigma, 1), 0)
        cos2 = 1 - sin_alpha**2
        cos_2m = np.where(cos2 > 1e-15, cos_sigma - 2 * s1 * s2 / np.where(cos2 > 1e-15, cos2, 1), 0)
        k = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        following = span + (1 - k) * FLATTENING * sin_alpha * (sigma + k * sin_sigma * (cos_2m + k * cos_sigma * (2 * cos_2m**2 - 1)))
        done = np.abs(following - lam).max(initial=0) < 1e-12
        lam = following
        if done:
            break
    squared = cos2 * (A**2 - b**2) / b**2
    big = 1 + squared / 16384 * (4096 + squared * (-768 + squared * (320 - 175 * squared)))
    small = squared / 1024 * (256 + squared * (-128 + squared * (74 - 47 * squared)))
    change = small * sin_sigma * (cos_2m + small / 4 * (cos_sigma * (2 * cos_2m**2 - 1) - small / 6 * cos_2m * (4 * sin_sigma**2 - 3) * (4 * cos_2m**2 - 3)))
    return b * big * (sigma - change)


def _points(line) -> np.ndarray:
    return np.array([(p["lat"], p["lon"]) for p in line], float).reshape(-1, 2)


def length_km(p: np.ndarray, rows: int = 1 << 16) -> float:
    """Geodesic length of a line of points (lat, lon), by stretches of so many points."""
    parts = range(0, len(p) - 1, rows)
    return float(sum(geodesic_m(*p[:-1][i : i + rows].T, *p[1:][i : i + rows].T).sum() for i in parts) / 1000)


@F.pandas_udf(T.DoubleType())
def line_km(lines: pd.Series) -> pd.Series:
    """Geodesic length of arrays of points (lat, lon)."""

    def length(line) -> float:
        p = _points(line)
        return float(geodesic_m(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1]).sum() / 1000) if len(p) > 1 else 0.0

    return lines.map(length)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay if none may lie further than ``tolerance`` from what is left (Douglas and Peucker)."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        inner = points[a + 1 : b] - points[a]
        size = float(d @ d)
        t = np.clip(inner @ d / size, 0, 1) if size > 0 else np.zeros(len(inner))
        far = np.sqrt(((inner - t[:, None] * d) ** 2).sum(axis=1))
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


@F.pandas_udf(T.ArrayType(_LATLON))
def simplified(lines: pd.Series, tolerance: pd.Series) -> pd.Series:
    def run(line, limit: float) -> list[dict]:
        p = _points(line)
        return [{"lat": y, "lon": x} for y, x in p[simplify(p, limit)].tolist()]

    return pd.Series([run(line, t) for line, t in zip(lines, tolerance, strict=True)])


_LINE = "file string, points int, km double, points_left int, km_left double"
_LINE_NAMES = [c.split()[0] for c in _LINE.split(", ")]


def lines(points: DataFrame, tolerance: float) -> DataFrame:
    """Each file's points (file, pt_no, lat, lon) as a line: their number and length, and both after simplification.

    A task holds one line's numbers at a time, however many lines and points there are.
    """

    def run(table: pa.Table) -> pa.Table:
        number, lat, lon = (table[c].to_numpy() for c in ("pt_no", "lat", "lon"))
        p = np.stack([lat, lon], axis=1)[np.lexsort((lon, lat, number))]
        less = p[simplify(p, tolerance)]
        told = [[table["file"][0].as_py()], [len(p)], [length_km(p)], [len(less)], [length_km(less)]]
        return pa.table([pa.array(v, t) for v, t in zip(told, (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64()), strict=True)], _LINE_NAMES)

    return points.select("file", "pt_no", "lat", "lon").groupBy("file").applyInArrow(run, _LINE)


# --- Transverse Mercator as Column functions -----------------------------------------------------

_N = FLATTENING / (2 - FLATTENING)
_E = (FLATTENING * (2 - FLATTENING)) ** 0.5
#: Krüger's series on the WGS84 ellipsoid, to the fourth power of the third flattening.
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_SCALE, _EAST, _NORTH = 0.9996, 500_000.0, 10_000_000.0


def utm(lat: Column, lon: Column, epsg: Column) -> Column:
    """Metres east and north (x, y) in a zone given by its number (32601 to 32660 and 32701 to 32760); millimetres off at most within the zone's neighbours."""
    phi, lam = F.radians(lat), F.radians(lon - (F.pmod(epsg, F.lit(100)) * 6 - 183))
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - F.lit(_E) * F.atanh(F.lit(_E) * sine))
    angles = F.array(F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)).alias("eta")))
    south = F.when(epsg >= 32700, F.lit(_NORTH)).otherwise(F.lit(0.0))

    def metres(v: Column) -> Column:
        east, north = v["eta"], v["xi"]
        for j, a in enumerate(_ALPHA, 1):
            east = east + a * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            north = north + a * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return F.struct((F.lit(_EAST) + _SCALE * _RECTIFYING * east).alias("x"), (south + _SCALE * _RECTIFYING * north).alias("y"))

    return F.transform(angles, metres)[0]  # the two angles are computed once

"""Distances and projections on the earth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from minekit.scale import col

EARTH_KM = 6371.0088
# WGS84 ellipsoid.
AXIS_M = 6378137.0
FLATTENING = 1 / 298.257223563


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = a2 - a1, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


@F.pandas_udf(DoubleType())
def _ellipsoid_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Vincenty inverse on WGS84, a whole Arrow batch per iteration."""
    b = AXIS_M * (1 - FLATTENING)
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat1.to_numpy(float))))
    u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat2.to_numpy(float))))
    gap = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = gap.copy()
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            c2a = 1 - sa**2
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / c2a)
            c = FLATTENING / 16 * c2a * (4 + FLATTENING * (4 - 3 * c2a))
            new = gap + (1 - c) * FLATTENING * sa * (
                sigma + c * ss * (c2m + c * cs * (-1 + 2 * c2m**2))
            )
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-12
            lam = new
            if done:
                break
        k = c2a * (AXIS_M**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        fix = big_b * ss * (
            c2m
            + big_b / 4 * (cs * (-1 + 2 * c2m**2) - big_b / 6 * c2m * (-3 + 4 * ss**2) * (-3 + 4 * c2m**2))
        )
    return pd.Series(b * big_a * (sigma - fix) / 1000)


def distance_km(lat1, lon1, lat2, lon2, exact: bool = False) -> Column:
    """Kilometres between two points: haversine, or the ellipsoidal geodesic with ``exact``."""
    if exact:
        return _ellipsoid_km(*[col(c).cast("double") for c in (lat1, lon1, lat2, lon2)])
    return haversine_km(lat1, lon1, lat2, lon2)


def unit_vector(lat, lon) -> list[Column]:
    """Point on the unit sphere; straight-line distance grows with the great-circle distance."""
    a, o = F.radians(col(lat)), F.radians(col(lon))
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def utm_zone(lon) -> Column:
    return (F.floor((col(lon) + 180) / 6) + 1).cast("int")


def to_utm(lat, lon, zone: int | None = None) -> tuple[Column, Column]:
    """Easting and northing in metres, own zone per point or one fixed zone; null when out of range."""
    lat, lon = col(lat).cast("double"), col(lon).cast("double")
    z = F.lit(zone) if zone is not None else utm_zone(lon)
    n = FLATTENING / (2 - FLATTENING)
    scale = 0.9996 * AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3,
        13 / 48 * n**2 - 3 / 5 * n**3,
        61 / 240 * n**3,
    ]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (z * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    ok = lat.between(-80, 84) & lon.between(-180, 180)
    shift = F.when(lat < 0, 10_000_000.0).otherwise(0.0)
    return F.when(ok, 500_000.0 + scale * east), F.when(ok, shift + scale * north)

"""Geodesics on the WGS84 ellipsoid, vectorised with numpy; and pandas UDFs of them.

Inverse and direct problems by Vincenty's series, iterated to convergence; nearly antipodal pairs, where the inverse
iteration does not converge, are solved by shooting: the direct problem is corrected on azimuth and length. Areas use the
authalic sphere with edges densified, since equal-area latitudes turn ellipsoidal areas into spherical excesses.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# WGS84.
A = 6_378_137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)


def _series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u2 = cos2 * (A * A - B * B) / (B * B)
    k = (np.sqrt(1 + u2) - 1) / (np.sqrt(1 + u2) + 1)
    return (1 + k * k / 4) / (1 - k), k * (1 - 3 * k * k / 8)


def _correction(big_b: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, cos_2m: np.ndarray) -> np.ndarray:
    inner = cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)
    return big_b * sin_s * (cos_2m + big_b / 4 * inner)


def direct(lat: np.ndarray, lon: np.ndarray, azimuth: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitude, longitude and azimuth (degrees) after ``metres`` along the geodesic that starts at ``azimuth``."""
    lat, lon, azimuth, metres = np.broadcast_arrays(*[np.asarray(v, float) for v in (lat, lon, azimuth, metres)])
    alpha = np.radians(azimuth)
    tan_u = (1 - FLAT) * np.tan(np.radians(lat))
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    sigma1 = np.arctan2(tan_u, np.cos(alpha))
    sin_a = cos_u * np.sin(alpha)
    cos2 = 1 - sin_a**2
    big_a, big_b = _series(cos2)
    sigma = start = metres / (B * big_a)
    for _ in range(12):
        cos_2m = np.cos(2 * sigma1 + sigma)
        sigma = start + _correction(big_b, np.sin(sigma), np.cos(sigma), cos_2m)
    cos_2m = np.cos(2 * sigma1 + sigma)
    sin_s, cos_s = np.sin(sigma), np.cos(sigma)
    across = sin_u * sin_s - cos_u * cos_s * np.cos(alpha)
    lat2 = np.arctan2(sin_u * cos_s + cos_u * sin_s * np.cos(alpha), (1 - FLAT) * np.hypot(sin_a, across))
    lam = np.arctan2(sin_s * np.sin(alpha), cos_u * cos_s - sin_u * sin_s * np.cos(alpha))
    c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    big_l = lam - (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
    lon2 = (lon + np.degrees(big_l) + 180) % 360 - 180
    return np.degrees(lat2), lon2, np.degrees(np.arctan2(sin_a, -across))


def inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Metres, azimuth at the first and azimuth at the second point (degrees) of the shortest geodesic."""
    lat1, lon1, lat2, lon2 = (np.asarray(v, float) for v in np.broadcast_arrays(lat1, lon1, lat2, lon2))
    with np.errstate(all="ignore"):
        big_l = np.radians((lon2 - lon1 + 180) % 360 - 180)
        u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(v))) for v in (lat1, lat2))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam = big_l.copy()
        for _ in range(60):
            sin_l, cos_l = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sin_l, c1 * s2 - s1 * c2 * cos_l)
            cos_s = s1 * s2 + c1 * c2 * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * sin_l / np.where(sin_s > 0, sin_s, 1), 0.0)
            cos2 = 1 - sin_a**2
            cos_2m = np.where(cos2 > 1e-14, cos_s - 2 * s1 * s2 / np.where(cos2 > 1e-14, cos2, 1), 0.0)
            c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
            new = big_l + (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            moved = np.abs(new - lam)
            lam = new
            if not (moved > 1e-13).any():
                break
        big_a, big_b = _series(cos2)
        metres = B * big_a * (sigma - _correction(big_b, sin_s, cos_s, cos_2m))
        azi1 = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))
        azi2 = np.degrees(np.arctan2(c1 * np.sin(lam), c1 * s2 * np.cos(lam) - s1 * c2))
        lost = ((moved > 1e-11) | (np.abs(lam) > np.pi)) & np.isfinite(big_l)
    same = (lat1 == lat2) & (big_l == 0)
    metres, azi1, azi2 = np.where(same, 0.0, metres), np.where(same, 180.0, azi1), np.where(same, 180.0, azi2)
    for k in np.flatnonzero(np.atleast_1d(lost)):
        found = _antipodal(*(float(np.atleast_1d(v)[k]) for v in (lat1, lon1, lat2, lon2)))
        if metres.ndim:
            metres[k], azi1[k], azi2[k] = found
        else:
            return tuple(np.asarray(v) for v in found)
    return metres, azi1, azi2


def _antipodal(lat1: float, lon1: float, lat2: float, lon2: float) -> tuple[float, float, float]:
    """The shortest geodesic to a nearly antipodal point: the best of many azimuths, refined around the best."""

    def miss(azimuth: np.ndarray, metres: np.ndarray) -> np.ndarray:
        y, x, _ = direct(np.full(azimuth.shape, lat1), np.full(azimuth.shape, lon1), azimuth, metres)
        dx = np.radians((x - lon2 + 180) % 360 - 180) * np.cos(np.radians(lat2))
        return np.hypot(np.radians(y - lat2), dx)

    centre, reach, middle, span = 0.0, 180.0, np.pi * (A + B) / 2, 80_000.0
    for _ in range(40):
        azimuths = centre + np.linspace(-reach, reach, 41)
        lengths = middle + np.linspace(-span, span, 41)
        grid_a, grid_s = np.meshgrid(azimuths, lengths)
        best = np.unravel_index(int(miss(grid_a, grid_s).argmin()), grid_a.shape)
        centre, middle = float(grid_a[best]), float(grid_s[best])
        reach, span = reach / 4, span / 4
    azi2 = float(direct(lat1, lon1, centre, middle)[2])
    return middle, (centre + 180) % 360 - 180, azi2


def _authalic(lat: np.ndarray) -> np.ndarray:
    """Latitude (radians) on the sphere of the ellipsoid's area."""
    e = np.sqrt(E2)

    def q(s: np.ndarray) -> np.ndarray:
        return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(e * s) / e)

    return np.arcsin(np.clip(q(np.sin(lat)) / q(np.array(1.0)), -1, 1))


AUTHALIC_M = float(np.sqrt(A * A / 2 * (1 + (1 - E2) * np.arctanh(np.sqrt(E2)) / np.sqrt(E2))))


def ring_measures(lon: np.ndarray, lat: np.ndarray, step_m: float = 20_000.0) -> tuple[float, float]:
    """Geodesic perimeter (m) and area (m2) of one closed or open ring; long edges are cut every ``step_m``."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if len(lon) and (lon[0] != lon[-1] or lat[0] != lat[-1]):
        lon, lat = np.append(lon, lon[0]), np.append(lat, lat[0])
    if len(lon) < 3:
        return 0.0, 0.0
    metres, azimuth, _ = inverse(lat[:-1], lon[:-1], lat[1:], lon[1:])
    pieces = np.maximum(1, np.ceil(metres / step_m).astype(int))
    edge = np.repeat(np.arange(len(metres)), pieces)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    y, x, _ = direct(lat[:-1][edge], lon[:-1][edge], azimuth[edge], metres[edge] * part / pieces[edge])
    y, x = np.radians(y), np.radians(x)
    beta = _authalic(y)
    step = np.diff(np.append(x, x[0]))
    step = (step + np.pi) % (2 * np.pi) - np.pi
    half = np.tan(beta / 2)
    following = np.append(half[1:], half[0])
    excess = 2 * np.arctan2(np.tan(step / 2) * (half + following), 1 + half * following)
    total = abs(excess.sum())
    if abs(step.sum()) > np.pi:  # the ring goes around a pole
        total = abs(2 * np.pi - total)
    return float(metres.sum()), float(total * AUTHALIC_M**2)


def distance_udf():  # noqa: ANN201 - a UDF
    """Geodesic metres between (lat, lon) and (lat, lon), as a pandas UDF."""

    @F.pandas_udf("double")
    def distance(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(inverse(*[s.to_numpy(float) for s in (lat1, lon1, lat2, lon2)])[0])

    return distance


def leg_udf():  # noqa: ANN201 - a UDF
    """struct(metres, azi1, azi2) of the geodesic between two points, null where one is missing."""

    @F.pandas_udf("metres double, azi1 double, azi2 double")
    def leg(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
        metres, azi1, azi2 = inverse(*[s.to_numpy(float) for s in (lat1, lon1, lat2, lon2)])
        return pd.DataFrame({"metres": metres, "azi1": azi1, "azi2": azi2})

    return leg

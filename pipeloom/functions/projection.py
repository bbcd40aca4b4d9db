"""Transverse Mercator of zone 37 north (WGS 84) as column expressions: Krueger's series to the third order (below 1 mm)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, the zone's meridian, scale and false easting.
A, FLAT, MERIDIAN, SCALE, EAST = 6378137.0, 1 / 298.257223563, 39.0, 0.9996, 500000.0
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECC = 2 * math.sqrt(N) / (1 + N)
# The series' coefficients by order.
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480]
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15]


def is_lon_lat(lon: Column, lat: Column) -> Column:
    """Whether the pair can be longitude and latitude in this order."""
    return lon.between(-180, 180) & lat.between(-90, 90)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    s, d = F.sin(F.radians(lat)), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * RADIUS * x, SCALE * RADIUS * y


def to_lon_lat(east: Column, north: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    xi, eta = north / (SCALE * RADIUS), (east - EAST) / (SCALE * RADIUS)
    y, x = xi, eta
    for j, b in enumerate(BETA, 1):
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    lat = chi
    for j, c in enumerate(DELTA, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return MERIDIAN + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(lat)


def sql_to_utm(lon: str, lat: str) -> tuple[str, str, str]:
    """For oracles: select items of xi and eta from s, t and d, and the two coordinates from them."""
    sh, ch = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
    ath = "(0.5::double * ln((1 + {0}) / (1 - {0})))"
    inner = f"sin(radians({lat})) as s, radians({lon} - {MERIDIAN}) as d"
    t = sh.format(f"({ath.format('s')} - {ECC!r}::double * {ath.format(f'({ECC!r}::double * s)')})")
    middle = f"atan2(t, cos(d)) as xi, {ath.format('(sin(d) / sqrt(1 + t * t))')} as eta"
    x = " + ".join(["eta", *(f"{a!r}::double * cos({2 * j} * xi) * {sh.format(f'{2 * j} * eta')}" for j, a in enumerate(ALPHA, 1))])
    y = " + ".join(["xi", *(f"{a!r}::double * sin({2 * j} * xi) * {ch.format(f'{2 * j} * eta')}" for j, a in enumerate(ALPHA, 1))])
    outer = f"round({EAST}::double + {SCALE * RADIUS!r}::double * ({x}), 3) as east, round({SCALE * RADIUS!r}::double * ({y}), 3) as north"
    return f"select *, {t} as t from (select *, {inner} from ", f"select *, {middle} from ", outer

"""Universal Transverse Mercator back to longitude and latitude on WGS84, by Krüger's series to the fourth order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
FALSE_EASTING, FALSE_NORTHING = 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, and the coefficients of Krüger's inverse series and of the latitude's.
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def utm_zone(code: str) -> tuple[int, bool] | None:
    """(zone, south) of a WGS84 code (EPSG:32601 to 32660 and 32701 to 32760)."""
    name, _, number = code.strip().upper().partition(":")
    n = int(number) if name == "EPSG" and number.isdigit() else 0
    if 32601 <= n <= 32660 or 32701 <= n <= 32760:
        return n % 100, n >= 32701
    return None


def utm_to_degrees(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Easting and northing in metres -> (longitude, latitude)."""
    xi = (y - F.lit(FALSE_NORTHING if south else 0.0)) / F.lit(SCALE * RECTIFYING)
    eta = (x - F.lit(FALSE_EASTING)) / F.lit(SCALE * RECTIFYING)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)) + F.lit(math.radians(6 * zone - 183))), F.degrees(lat)

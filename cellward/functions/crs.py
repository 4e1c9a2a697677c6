"""Map projections, for columns and for plain numbers.

Each function takes coordinates and where the mathematics comes from: ``pyspark.sql.functions`` for columns (the
default), or ``math`` for numbers on the driver.  Longitudes and latitudes are degrees, projected coordinates metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axes and flattening of GRS80, and the parameters of EPSG:3035.
A, FLATTENING = 6378137.0, 1 / 298.257222101
LON0, LAT0, EAST0, NORTH0 = 10.0, 52.0, 4321000.0, 3210000.0

E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)
#: Newton's steps for Mollweide's angle.  They halve the error near the poles, where the equation has a double root.
STEPS = 40


def _authalic(s, m):
    return (1 - E2) * (s / (1 - E2 * s * s) - m.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


_QP = _authalic(1.0, math)
_RQ = A * math.sqrt(_QP / 2)
_B0 = math.asin(_authalic(math.sin(math.radians(LAT0)), math) / _QP)
_D = A * math.cos(math.radians(LAT0)) / math.sqrt(1 - E2 * math.sin(math.radians(LAT0)) ** 2) / (_RQ * math.cos(_B0))


def _clamped(v, m):
    """For arc sines of what rounding may have pushed past 1."""
    return F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) if m is F else min(max(v, -1.0), 1.0)


def laea(lon, lat, m=F):
    """Lambert azimuthal equal-area on the ellipsoid (EPSG:3035): east, north."""
    beta = m.asin(_clamped(_authalic(m.sin(m.radians(lat)), m) / _QP, m))
    dl = m.radians(lon - LON0)
    s0, c0 = math.sin(_B0), math.cos(_B0)
    b = _RQ * m.sqrt(2 / (1 + s0 * m.sin(beta) + c0 * m.cos(beta) * m.cos(dl)))
    return EAST0 + b * _D * m.cos(beta) * m.sin(dl), NORTH0 + b / _D * (c0 * m.sin(beta) - s0 * m.cos(beta) * m.cos(dl))


def laea_inverse(east, north, m=F):
    x, y = (east - EAST0) / _D, (north - NORTH0) * _D
    rho = m.sqrt(x * x + y * y)
    c = 2 * m.asin(_clamped(rho / (2 * _RQ), m))
    s0, c0 = math.sin(_B0), math.cos(_B0)
    ratio = F.when(rho == 0, 0.0).otherwise(y * m.sin(c) / rho) if m is F else (y * m.sin(c) / rho if rho else 0.0)
    beta = m.asin(_clamped(m.cos(c) * s0 + ratio * c0, m))
    lon = LON0 + m.degrees(m.atan2(x * m.sin(c), rho * c0 * m.cos(c) - y * s0 * m.sin(c)))
    e4, e6 = E2 * E2, E2 * E2 * E2
    lat = beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta) + 761 * e6 / 45360 * m.sin(6 * beta)
    return lon, m.degrees(lat)


def _mollweide_angle(lat, m):
    """The angle t with 2 t + sin 2 t = pi sin(lat)."""
    want = math.pi * m.sin(m.radians(lat))
    if m is F:
        way = lambda t, w: t - F.coalesce(F.try_divide(2 * t + F.sin(2 * t) - w, 2 + 2 * F.cos(2 * t)), F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.radians(lat.cast("double")), lambda t, _: way(t, want))
    t = math.radians(lat)
    for _ in range(STEPS):
        slope = 2 + 2 * math.cos(2 * t)
        t -= (2 * t + math.sin(2 * t) - want) / slope if slope else 0.0
    return t


def mollweide(lon, lat, m=F):
    """Mollweide on the sphere of the ellipsoid's axis (ESRI:54009)."""
    t = _mollweide_angle(lat, m)
    return 2 * math.sqrt(2) / math.pi * A * m.radians(lon) * m.cos(t), math.sqrt(2) * A * m.sin(t)


def mollweide_inverse(x, y, m=F):
    t = m.asin(_clamped(y / (math.sqrt(2) * A), m))
    lat = m.degrees(m.asin(_clamped((2 * t + m.sin(2 * t)) / math.pi, m)))
    flat = m.cos(t)
    lon = x * math.pi / (2 * math.sqrt(2) * A)
    return m.degrees(F.coalesce(F.try_divide(lon, flat), F.lit(0.0)) if m is F else (lon / flat if flat else 0.0)), lat


def mercator(lon, lat, m=F):
    """Web Mercator (EPSG:3857)."""
    return A * m.radians(lon), A * m.log(m.tan(math.pi / 4 + m.radians(lat) / 2))


def mercator_inverse(x, y, m=F):
    return m.degrees(x / A), m.degrees(2 * m.atan(m.exp(y / A)) - math.pi / 2)


def _same(x, y, m=F):
    return x, y


#: By name: from and to degrees.
SYSTEMS = {"EPSG:4326": (_same, _same), "EPSG:3035": (laea, laea_inverse), "ESRI:54009": (mollweide, mollweide_inverse), "EPSG:3857": (mercator, mercator_inverse)}


def transform(x: Column | float, y: Column | float, source: str, target: str, m=F):
    """Coordinates of one system in another; an unknown name is an error."""
    for name in (source, target):
        if name not in SYSTEMS:
            raise ValueError(f"unknown coordinate system {name}")
    return (x, y) if source == target else SYSTEMS[target][0](*SYSTEMS[source][1](x, y, m), m)


def transform_bounds(box: tuple[float, float, float, float], source: str, target: str, between: int = 21) -> tuple[float, float, float, float]:
    """West, south, east, north of a box in another system, from its corners and ``between`` more points on each side."""
    w, s, e, n = box
    steps = [k / (between + 1) for k in range(between + 2)]
    rim = [(w + (e - w) * t, y) for t in steps for y in (s, n)] + [(x, s + (n - s) * t) for t in steps for x in (w, e)]
    xs, ys = zip(*(transform(x, y, source, target, math) for x, y in rim))
    return min(xs), min(ys), max(xs), max(ys)

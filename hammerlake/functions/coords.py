"""From projected coordinates to longitude and latitude: column arithmetic only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The projection (transverse Mercator on Bessel's ellipsoid), the shift to WGS84 (metres, seconds of arc, parts per
# million), both ellipsoids, and the bounds of provinces and of the country (west, south, east, north).
LAT_0, LON_0, SCALE, X_0, Y_0 = 38.0, 128.0, 0.9999, 400_000.0, 600_000.0
SHIFT = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)
BESSEL, WGS84 = (6377397.155, 1 / 299.1528128), (6378137.0, 1 / 298.257223563)
BOUNDS = {
    "서울": (126.76, 37.41, 127.19, 37.72), "부산": (128.75, 34.98, 129.31, 35.40), "대구": (128.35, 35.60, 128.77, 36.02), "인천": (126.36, 37.33, 126.80, 37.62),
    "광주": (126.64, 35.05, 127.02, 35.26), "대전": (127.24, 36.18, 127.56, 36.50), "울산": (129.03, 35.31, 129.47, 35.72), "경기": (126.39, 36.89, 127.86, 38.30),
    "강원": (127.06, 37.02, 129.37, 38.62), "충북": (127.26, 36.01, 128.22, 37.22), "충남": (125.90, 35.97, 127.39, 37.05), "전북": (125.95, 35.30, 127.90, 36.15),
    "전남": (125.06, 33.89, 127.90, 35.50), "경북": (127.79, 35.56, 129.70, 37.55), "경남": (127.46, 34.55, 129.29, 35.91), "제주": (126.08, 33.10, 126.98, 33.60), "세종": (127.10, 36.40, 127.42, 36.73),
}
COUNTRY = (124.5, 33.0, 131.0, 38.7)


def _square_eccentricity(flattening: float) -> float:
    return flattening * (2 - flattening)


def _meridian(lat: float, a: float, e2: float) -> float:
    """Length of the meridian from the equator."""
    return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * lat) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * lat) - (35 * e2**3 / 3072) * math.sin(6 * lat))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def _named(**columns: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in columns.items()])


def to_wgs84(x: Column, y: Column) -> Column:
    """``(lon, lat)`` in degrees of projected ``x`` and ``y`` in metres; null where either is null or 0.

    The series of the inverse projection (Snyder, "Map Projections", 8-17 to 8-25), then the shift of seven parameters between the
    ellipsoids, by way of coordinates in space; the latitude behind it by Bowring's formula, once, which is exact to millimetres here.
    """
    a, e2 = BESSEL[0], _square_eccentricity(BESSEL[1])
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (_meridian(math.radians(LAT_0), a, e2) + (y - Y_0) / SCALE) / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = _let(mu, lambda m: m + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * m) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * m) + (151 * e1**3 / 96) * F.sin(6 * m) + (1097 * e1**4 / 512) * F.sin(8 * m))
    trig = _let(foot, lambda f: _named(f=f, sin=F.sin(f), cos=F.cos(f), tan=F.tan(f)))
    series = _let(trig, lambda g: _named(f=g["f"], cos=g["cos"], tan=g["tan"], c=ep2 * g["cos"] * g["cos"], t=g["tan"] * g["tan"], n=a / F.sqrt(1 - e2 * g["sin"] * g["sin"]), r=a * (1 - e2) / F.pow(1 - e2 * g["sin"] * g["sin"], F.lit(1.5))))
    series = _let(series, lambda g: _named(f=g["f"], cos=g["cos"], tan=g["tan"], c=g["c"], t=g["t"], n=g["n"], r=g["r"], d=(x - X_0) / (g["n"] * SCALE)))

    def sphere(g: Column) -> Column:
        c, t, d = g["c"], g["t"], g["d"]
        lat = g["f"] - (g["n"] * g["tan"] / g["r"]) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d**6 / 720)
        lon = math.radians(LON_0) + (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d**5 / 120) / g["cos"]
        return _named(lat=lat, lon=lon)

    def space(g: Column) -> Column:
        nu = a / F.sqrt(1 - e2 * F.sin(g["lat"]) * F.sin(g["lat"]))
        return _let(nu, lambda v: _named(p=v * F.cos(g["lat"]) * F.cos(g["lon"]), q=v * F.cos(g["lat"]) * F.sin(g["lon"]), s=v * (1 - e2) * F.sin(g["lat"])))

    dx, dy, dz, *angles, ppm = SHIFT
    rx, ry, rz = (math.radians(v / 3600) for v in angles)
    k = 1 + ppm * 1e-6
    shifted = _let(_let(_let(series, sphere), space), lambda g: _named(u=dx + k * (g["p"] - rz * g["q"] + ry * g["s"]), v=dy + k * (rz * g["p"] + g["q"] - rx * g["s"]), w=dz + k * (-ry * g["p"] + rx * g["q"] + g["s"])))
    b, w2 = WGS84[0] * (1 - WGS84[1]), _square_eccentricity(WGS84[1])
    angled = _let(shifted, lambda g: _named(u=g["u"], v=g["v"], w=g["w"], flat=F.sqrt(g["u"] * g["u"] + g["v"] * g["v"])))
    angled = _let(angled, lambda g: _named(u=g["u"], v=g["v"], w=g["w"], flat=g["flat"], theta=F.atan2(g["w"] * WGS84[0], g["flat"] * b)))
    cube = lambda z: z * z * z
    out = _let(angled, lambda g: _named(lon=F.degrees(F.atan2(g["v"], g["u"])), lat=F.degrees(F.atan2(g["w"] + w2 / (1 - w2) * b * cube(F.sin(g["theta"])), g["flat"] - w2 * WGS84[0] * cube(F.cos(g["theta"]))))))
    return F.when((x != 0) & (y != 0), out)


def plausible(lon: Column, lat: Column, address: Column) -> Column:
    """Whether a point lies in the province that the beginning of its address names, or else in the country."""
    head = F.substring(F.coalesce(address, F.lit("")), 1, 8)
    within = lambda w, s, e, n: lon.between(w, e) & lat.between(s, n)
    named = [F.when(F.contains(head, F.lit(k)), within(*v)) for k, v in BOUNDS.items()]
    return F.coalesce(*named, within(*COUNTRY))

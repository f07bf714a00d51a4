"""Coordinate reference systems as expressions: projections to and from longitude and latitude, and shifts between datums.

Mercator and transverse Mercator, Lambert's conformal cone, Albers' equal-area cone, Lambert's equal-area azimuthal and the polar
stereographic projection, all of the ellipsoid.  Known codes are in SYSTEMS and by rule (zones); `define` adds others by their
parameters, and codes of neither kind raise ValueError.  Systems without a shift share one datum: WGS 84, NAD83, ETRS89, GDA94
and NZGD2000 are taken as one.  Everything stays inside the JVM, and no row is moved.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6378137.0
WGS84, GRS80 = 298.257223563, 298.257222101
AIRY = (6377563.396, 299.3249646)


class System(NamedTuple):
    """A system: its method, ellipsoid, origin in degrees, scale, false origin in metres, parallels, and shift to WGS 84.

    Methods: geographic, mercator (of the sphere), tm, lcc, aea, laea, stere.  `lat1` and `lat2` are the parallels of the cones (of a
    cone that touches, both are `lat0`); for stere `lat1` is the parallel of true scale, whose sign tells the pole.  `shift` holds
    translations in metres, rotations of the position vector in seconds of arc, and a scale difference in millionths.
    """

    method: str
    lat0: float = 0.0
    lon0: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    radius: float = RADIUS
    inverse_flattening: float = GRS80
    shift: tuple[float, ...] | None = None

    @property
    def e2(self) -> float:
        """The square of the eccentricity."""
        return (2 - 1 / self.inverse_flattening) / self.inverse_flattening


OSGB36 = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
#: The published parameters of the codes.
SYSTEMS = {
    4326: System("geographic", inverse_flattening=WGS84),
    4269: System("geographic"),
    4258: System("geographic"),
    4277: System("geographic", radius=AIRY[0], inverse_flattening=AIRY[1], shift=OSGB36),
    3857: System("mercator", inverse_flattening=WGS84),
    2154: System("lcc", 46.5, 3, 1, 700_000, 6_600_000, 49, 44),
    2193: System("tm", 0, 173, 0.9996, 1_600_000, 10_000_000),
    3005: System("aea", 45, -126, 1, 1_000_000, 0, 50, 58.5),
    3031: System("stere", -90, 0, lat1=-71, inverse_flattening=WGS84),
    3034: System("lcc", 52, 10, 1, 4_000_000, 2_800_000, 35, 65),
    3035: System("laea", 52, 10, 1, 4_321_000, 3_210_000),
    3310: System("aea", 0, -120, 1, 0, -4_000_000, 34, 40.5),
    3413: System("stere", 90, -45, lat1=70, inverse_flattening=WGS84),
    3978: System("lcc", 49, -95, 1, 0, 0, 49, 77),
    5070: System("aea", 23, -96, 1, 0, 0, 29.5, 45.5),
    27700: System("tm", 49, -2, 0.9996012717, 400_000, -100_000, radius=AIRY[0], inverse_flattening=AIRY[1], shift=OSGB36),
}
#: (first code, last code, code before zone 1, south, inverse flattening) of zones six degrees wide.
ZONES = [(32601, 32660, 32600, False, WGS84), (32701, 32760, 32700, True, WGS84), (26901, 26923, 26900, False, GRS80), (25828, 25838, 25800, False, GRS80), (28348, 28358, 28300, True, GRS80)]
_defined: dict[int, System] = {}


def parse(code: str | int) -> int:
    """The EPSG number of `26910`, `"EPSG:26910"` and the like."""
    try:
        return int(str(code).upper().removeprefix("EPSG:"))
    except ValueError:
        raise ValueError(f"invalid CRS: {code}") from None


def define(code: str | int, given: System) -> None:
    """Make a system known by a code, for this process; codes that are known already keep their meaning."""
    number = parse(code)
    if given.method not in METHODS:
        raise ValueError(f"unknown projection: {given.method}")
    if given.method in ("lcc", "aea", "stere") and given.lat1 is None:
        raise ValueError(f"{given.method} needs lat1")
    if given.method == "laea" and abs(given.lat0) == 90:
        raise ValueError("laea at a pole isn't built")
    if (known := find(number)) is not None and known != given:
        raise ValueError(f"CRS {number} is known already")
    _defined[number] = given


def find(code: int) -> System | None:
    """The system of a code, or None."""
    if found := SYSTEMS.get(code) or _defined.get(code):
        return found
    for first, last, base, south, flattening in ZONES:
        if first <= code <= last:
            return System("tm", 0, (code - base) * 6 - 183, 0.9996, 500_000, 1e7 if south else 0.0, inverse_flattening=flattening)
    return None


def system(code: int) -> System:
    """The system of a code; unknown ones raise."""
    if (found := find(code)) is None:
        raise ValueError(f"unsupported CRS: {code}")
    return found


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def _isometric(phi: Column, e: float, let: Let) -> Column:
    """Isometric latitude, finite at the poles."""
    phi, tan = let(phi, F.tan(phi))
    return F.signum(tan) * F.asinh(F.abs(tan)) - e * _atanh(e * F.sin(phi))


def _latitude(psi: Column, e: float, let: Let) -> Column:
    """Latitude from the isometric one, by fixed-point steps."""
    (psi,) = let(psi)
    phi = F.atan(F.sinh(psi))
    for _ in range(5):
        (s,) = let(e * F.sin(phi))
        phi = F.atan(F.sinh(psi + e * _atanh(s)))
    return phi


def _authalic(s: Column, e: float, let: Let) -> Column:
    """Snyder's q of the sine of a latitude."""
    (s,) = let(s)
    return (1 - e * e) * (s / (1 - e * e * s * s) + _atanh(e * s) / e)


def _from_authalic(sine: Column, e: float, let: Let) -> Column:
    """Latitude from the sine of the authalic latitude, by a series whose coefficients are computed for the ellipsoid."""
    (beta,) = let(F.asin(F.greatest(F.least(sine, F.lit(1.0)), F.lit(-1.0))))
    phi = beta
    for k, c in enumerate(_sines(e), 1):
        phi += c * F.sin(2 * k * beta)
    return phi


@functools.cache
def _sines(e: float, terms: int = 6, n: int = 64) -> tuple[float, ...]:
    """Fourier coefficients of the latitude less the authalic latitude, in sines of even multiples of the latter."""
    out = [0.0] * terms
    for i in range(1, n):
        beta = math.pi * i / (2 * n)
        s = math.sin(beta)
        q = s * _q(90, e)
        for _ in range(6):
            s -= ((1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e) - q) / (1 - e * e) * (1 - e * e * s * s) ** 2 / 2
        for k in range(1, terms + 1):
            out[k - 1] += 2 / n * (math.asin(s) - beta) * math.sin(2 * k * beta)
    return tuple(out)


def _psi(degrees: float, e: float) -> float:
    s = math.sin(math.radians(degrees))
    return math.asinh(math.tan(math.radians(degrees))) - e * math.atanh(e * s)


def _m(degrees: float, e: float) -> float:
    return math.cos(math.radians(degrees)) / math.sqrt(1 - (e * math.sin(math.radians(degrees))) ** 2)


def _q(degrees: float, e: float) -> float:
    s = math.sin(math.radians(degrees))
    return (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)


def _turned(lon: Column, s: System) -> Column:
    """Radians east of the central meridian, from -pi to pi."""
    d = F.radians(lon - s.lon0)
    return F.atan2(F.sin(d), F.cos(d))


Pair = tuple[Column, Column]
#: Gives expressions back as columns to be read more than once, each computed once for a row.
Let = Callable[..., tuple[Column, ...]]


def _as_is(*columns: Column) -> tuple[Column, ...]:
    return columns


def _geographic(a: Column, b: Column, s: System, let: Let) -> Pair:
    return a, b


def _mercator(lon: Column, lat: Column, s: System, let: Let) -> Pair:
    return F.radians(lon) * s.radius, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * s.radius


def _from_mercator(x: Column, y: Column, s: System, let: Let) -> Pair:
    return F.degrees(x / s.radius), F.degrees(2 * F.atan(F.exp(y / s.radius)) - math.pi / 2)


def _series(s: System) -> tuple[float, list[float], list[float], float]:
    """Rectifying radius, forward and inverse Krüger coefficients to order 4, and the northing of the origin."""
    f = 1 / s.inverse_flattening
    n = f / (2 - f)
    a = s.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    inverse = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    xi = math.atan(math.sinh(_psi(s.lat0, math.sqrt(s.e2))))
    return a, forward, inverse, xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(forward, 1))


def _tm(lon: Column, lat: Column, s: System, let: Let) -> Pair:
    a, forward, _, origin = _series(s)
    e = math.sqrt(s.e2)
    dl, sine = let(F.radians(lon - s.lon0), F.sin(F.radians(lat)))
    dl, t = let(dl, F.sinh(_atanh(sine) - e * _atanh(e * sine)))
    xi, ratio = let(F.atan2(t, F.cos(dl)), F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = let(xi, _atanh(ratio))
    x, y = eta, xi - origin
    for j, c in enumerate(forward, 1):
        x += c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y += c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return s.x0 + s.scale * a * x, s.y0 + s.scale * a * y


def _from_tm(x: Column, y: Column, s: System, let: Let) -> Pair:
    a, _, inverse, origin = _series(s)
    xi, eta = let((y - s.y0) / (s.scale * a) + origin, (x - s.x0) / (s.scale * a))
    u, v = xi, eta
    for j, c in enumerate(inverse, 1):
        u -= c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v -= c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    u, v = let(u, v)
    lon, sine = let(s.lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.sin(u) / F.cosh(v))
    return lon, F.degrees(_latitude(_atanh(sine), math.sqrt(s.e2), let))


def _parallels(s: System) -> tuple[float, float]:
    return s.lat1, s.lat1 if s.lat2 is None else s.lat2


def _cone(s: System) -> tuple[float, float, float]:
    """Lambert's conformal cone: its constant, the radius of the equator's circle, and that of the origin."""
    e, (one, two) = math.sqrt(s.e2), _parallels(s)
    n = math.sin(math.radians(one)) if one == two else math.log(_m(one, e) / _m(two, e)) / (_psi(two, e) - _psi(one, e))
    equator = s.radius * s.scale * _m(one, e) * math.exp(n * _psi(one, e)) / n
    return n, equator, equator * math.exp(-n * _psi(s.lat0, e))


def _lcc(lon: Column, lat: Column, s: System, let: Let) -> Pair:
    n, equator, origin = _cone(s)
    rho, turn = let(equator * F.exp(-n * _isometric(F.radians(lat), math.sqrt(s.e2), let)), n * _turned(lon, s))
    return s.x0 + rho * F.sin(turn), s.y0 + origin - rho * F.cos(turn)


def _from_cone(x: Column, y: Column, s: System, n: float, origin: float, let: Let) -> Pair:
    """Longitude in degrees and the distance from the apex."""
    sign = math.copysign(1.0, n)
    dx, dy = let(x - s.x0, origin - (y - s.y0))
    return let(s.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / n), sign * F.sqrt(dx * dx + dy * dy))


def _from_lcc(x: Column, y: Column, s: System, let: Let) -> Pair:
    n, equator, origin = _cone(s)
    lon, rho = _from_cone(x, y, s, n, origin, let)
    return lon, F.degrees(_latitude(F.log(F.greatest(rho / equator, F.lit(1e-300))) / -n, math.sqrt(s.e2), let))


def _equal_area_cone(s: System) -> tuple[float, float, float]:
    """Albers' cone: its constant, C, and the radius of the origin."""
    e, (one, two) = math.sqrt(s.e2), _parallels(s)
    n = math.sin(math.radians(one)) if one == two else (_m(one, e) ** 2 - _m(two, e) ** 2) / (_q(two, e) - _q(one, e))
    c = _m(one, e) ** 2 + n * _q(one, e)
    return n, c, s.radius * math.sqrt(c - n * _q(s.lat0, e)) / n


def _aea(lon: Column, lat: Column, s: System, let: Let) -> Pair:
    n, c, origin = _equal_area_cone(s)
    rho = F.sqrt(F.greatest(c - n * _authalic(F.sin(F.radians(lat)), math.sqrt(s.e2), let), F.lit(0.0))) * (s.radius / n)
    rho, turn = let(rho, n * _turned(lon, s))
    return s.x0 + rho * F.sin(turn), s.y0 + origin - rho * F.cos(turn)


def _from_aea(x: Column, y: Column, s: System, let: Let) -> Pair:
    n, c, origin = _equal_area_cone(s)
    lon, rho = _from_cone(x, y, s, n, origin, let)
    return lon, F.degrees(_from_authalic((c - (rho * n / s.radius) ** 2) / (n * _q(90, math.sqrt(s.e2))), math.sqrt(s.e2), let))


def _sphere(s: System) -> tuple[float, float, float, float]:
    """The equal-area sphere: its radius, the stretch, and sine and cosine of the origin's latitude on it."""
    e = math.sqrt(s.e2)
    radius, sine = s.radius * math.sqrt(_q(90, e) / 2), _q(s.lat0, e) / _q(90, e)
    cosine = math.sqrt(1 - sine * sine)
    return radius, s.radius * _m(s.lat0, e) / (radius * cosine), sine, cosine


def _laea(lon: Column, lat: Column, s: System, let: Let) -> Pair:
    radius, stretch, sine, cosine = _sphere(s)
    e = math.sqrt(s.e2)
    sb, turn = let(_authalic(F.sin(F.radians(lat)), e, let) / _q(90, e), _turned(lon, s))
    sb, cb, turn = let(sb, F.sqrt(F.greatest(1 - sb * sb, F.lit(0.0))), turn)
    # The point opposite to the origin has no image.
    sb, cb, turn, b = let(sb, cb, turn, radius * F.sqrt(F.try_divide(F.lit(2.0), F.greatest(1 + sine * sb + cosine * cb * F.cos(turn), F.lit(0.0)))))
    return s.x0 + b * stretch * cb * F.sin(turn), s.y0 + b / stretch * (cosine * sb - sine * cb * F.cos(turn))


def _from_laea(x: Column, y: Column, s: System, let: Let) -> Pair:
    radius, stretch, sine, cosine = _sphere(s)
    e = math.sqrt(s.e2)
    dx, dy = let((x - s.x0) / stretch, (y - s.y0) * stretch)
    dx, dy, rho = let(dx, dy, F.sqrt(dx * dx + dy * dy))
    dx, dy, rho, c = let(dx, dy, rho, 2 * F.asin(F.least(rho / (2 * radius), F.lit(1.0))))
    part = F.coalesce(F.try_divide(dy * F.sin(c), rho), 0 * dy)
    sb = F.cos(c) * sine + part * cosine
    return s.lon0 + F.degrees(F.atan2(dx * F.sin(c), rho * cosine * F.cos(c) - dy * sine * F.sin(c))), F.degrees(_from_authalic(sb, e, let))


def _pole(s: System) -> tuple[float, float]:
    """1 for the north pole or -1, and the radius of the equator's circle."""
    e, sign = math.sqrt(s.e2), math.copysign(1.0, s.lat1)
    if abs(s.lat1) == 90:
        return sign, 2 * s.radius * s.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    return sign, s.radius * s.scale * _m(abs(s.lat1), e) * math.exp(_psi(abs(s.lat1), e))


def _stere(lon: Column, lat: Column, s: System, let: Let) -> Pair:
    sign, equator = _pole(s)
    rho, turn = let(equator * F.exp(-_isometric(sign * F.radians(lat), math.sqrt(s.e2), let)), _turned(lon, s))
    return s.x0 + rho * F.sin(turn), s.y0 - sign * rho * F.cos(turn)


def _from_stere(x: Column, y: Column, s: System, let: Let) -> Pair:
    sign, equator = _pole(s)
    dx, dy = let(x - s.x0, y - s.y0)
    rho = F.greatest(F.sqrt(dx * dx + dy * dy) / equator, F.lit(1e-300))
    return s.lon0 + F.degrees(F.atan2(dx, -sign * dy)), sign * F.degrees(_latitude(-F.log(rho), math.sqrt(s.e2), let))


#: (from longitude and latitude, to them) of each method.
METHODS: dict[str, tuple[Callable[[Column, Column, System, Let], Pair], Callable[[Column, Column, System, Let], Pair]]] = {
    "geographic": (_geographic, _geographic),
    "mercator": (_mercator, _from_mercator),
    "tm": (_tm, _from_tm),
    "lcc": (_lcc, _from_lcc),
    "aea": (_aea, _from_aea),
    "laea": (_laea, _from_laea),
    "stere": (_stere, _from_stere),
}


def from_lonlat(lon: Column, lat: Column, code: int, let: Let = _as_is) -> Pair:
    """Projected x and y of degrees on the system's own datum."""
    s = system(code)
    return METHODS[s.method][0](lon, lat, s, let)


def to_lonlat(x: Column, y: Column, code: int, let: Let = _as_is) -> Pair:
    """Degrees on the system's own datum of projected x and y."""
    s = system(code)
    return METHODS[s.method][1](x, y, s, let)


def geocentric(lon: Column, lat: Column, s: System) -> tuple[Column, Column, Column]:
    """Metres from the earth's centre of a point on the ellipsoid."""
    phi, lam = F.radians(lat), F.radians(lon)
    v = s.radius / F.sqrt(1 - s.e2 * F.sin(phi) ** 2)
    return v * F.cos(phi) * F.cos(lam), v * F.cos(phi) * F.sin(lam), v * (1 - s.e2) * F.sin(phi)


def from_geocentric(x: Column, y: Column, z: Column, s: System) -> Pair:
    """Degrees of a point near the ellipsoid, by Bowring's formula."""
    minor = s.radius * math.sqrt(1 - s.e2)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * s.radius, p * minor)
    second = s.e2 / (1 - s.e2)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z + second * minor * F.sin(theta) ** 3, p - s.e2 * s.radius * F.cos(theta) ** 3))


def helmert(x: Column, y: Column, z: Column, shift: tuple[float, ...], back: bool = False) -> tuple[Column, Column, Column]:
    """The position vector transformation of seven parameters, or its exact inverse."""
    rx, ry, rz = (math.radians(r / 3600) for r in shift[3:6])
    m = 1 + shift[6] * 1e-6
    if not back:
        return shift[0] + m * (x - rz * y + ry * z), shift[1] + m * (rz * x + y - rx * z), shift[2] + m * (-ry * x + rx * y + z)
    u, v, w = (x - shift[0]) / m, (y - shift[1]) / m, (z - shift[2]) / m
    # The matrix is the identity plus a cross product with r, so its inverse is in closed form.
    dot, square = rx * u + ry * v + rz * w, 1 + rx * rx + ry * ry + rz * rz
    return (u - (ry * w - rz * v) + rx * dot) / square, (v - (rz * u - rx * w) + ry * dot) / square, (w - (rx * v - ry * u) + rz * dot) / square


def reproject(df: DataFrame, source: str | int, target: str | int, x: str = "x", y: str = "y") -> DataFrame:
    """`df` with its coordinates in another system, both null where one is; heights are left as they are.

    What is read more than once gets a column of its own on the way, so that no expression is repeated inside another and the
    whole stays within generated code.
    """
    a, b = parse(source), parse(target)
    if a == b:
        return df
    one, two = system(a), system(b)
    mark, names = uuid.uuid4().hex, []

    def let(*columns: Column) -> tuple[Column, ...]:
        nonlocal df
        new = [f"c{len(names) + i}_{mark}" for i in range(len(columns))]
        names.extend(new)
        df = df.withColumns(dict(zip(new, columns, strict=True)))
        return tuple(F.col(c) for c in new)

    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = let(F.when(known, F.col(x)), F.when(known, F.col(y)))
    lon, lat = let(*to_lonlat(px, py, a, let))
    if one.shift != two.shift:
        at = let(*geocentric(lon, lat, one))
        if one.shift:
            at = let(*helmert(*at, one.shift))
        if two.shift:
            at = let(*helmert(*at, two.shift, back=True))
        lon, lat = let(*from_geocentric(*at, two))
    new = from_lonlat(lon, lat, b, let)
    return df.withColumns({x: F.when(known, new[0]), y: F.when(known, new[1])}).drop(*names)

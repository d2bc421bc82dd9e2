"""Projections as data: parameters of an ellipsoid, a projection and a shift of datum, and the maths for whole arrays of places.

Longitudes and latitudes are degrees on WGS 84; what a projection's own datum makes of them is its `shift`. Places are on the ellipsoid, so
the height that a shift gives them is dropped, which moves a place by some millimetres there and back. Arrays in, arrays out, nan for
what has no place; the columns of a table go through Arrow batches (forward_columns, inverse_columns), as the expressions of a series or
an iteration would be thousands of terms of a plan. UTM, web Mercator and degrees are plain expressions in functions.coordinates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: semi-major axis and inverse flattening of ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "Airy1830": (6377563.396, 299.3249646),
    "Clarke1866": (6378206.4, 294.978698214),
    "International1924": (6378388.0, 297.0),
    "Krassowsky1940": (6378245.0, 298.3),
}
KINDS = ("lonlat", "transverse_mercator", "lambert_conformal", "albers", "polar_stereographic")


@dataclass(frozen=True)
class Projection:
    """A coordinate system. Degrees for angles, metres for x0, y0 and the axis; unit: metres of its unit of length.

    lambert_conformal and albers take two standard parallels (lat1, lat2; one parallel twice with a scale is the form with one);
    polar_stereographic takes the scale at the pole, or in lat1 the parallel of true scale, and its pole by the sign of lat0.
    shift: three or seven parameters to WGS 84 (metres, arc seconds, parts per million) as position vectors turn, or none."""

    kind: str
    axis: float = 6378137.0
    inverse_flattening: float = 298.257223563
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0
    shift: tuple[float, ...] | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown projection: {self.kind}")
        if self.shift is not None and len(self.shift) not in (3, 7):
            raise ValueError("a shift of datum has three or seven parameters")
        if self.kind in ("lambert_conformal", "albers") and self.lat1 is None:
            raise ValueError(f"{self.kind} needs a standard parallel")

    @property
    def flattening(self) -> float:
        return 1 / self.inverse_flattening if self.inverse_flattening else 0.0

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def e(self) -> float:
        return float(np.sqrt(self.e2))


WGS84 = Projection("lonlat")


def geocentric(p: Projection, lon: np.ndarray, lat: np.ndarray, height: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X, Y, Z in metres of places (degrees) on the projection's ellipsoid."""
    lam, phi = np.radians(lon), np.radians(lat)
    nu = p.axis / np.sqrt(1 - p.e2 * np.sin(phi) ** 2)
    return (nu + height) * np.cos(phi) * np.cos(lam), (nu + height) * np.cos(phi) * np.sin(lam), ((1 - p.e2) * nu + height) * np.sin(phi)


def geodetic(p: Projection, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees: a parametric latitude, corrected until it stands (three steps)."""
    away = np.hypot(x, y)
    b = p.axis * (1 - p.flattening)
    beta = np.arctan2(z * p.axis, away * b)
    for _ in range(3):
        phi = np.arctan2(z + p.e2 / (1 - p.e2) * b * np.sin(beta) ** 3, away - p.e2 * p.axis * np.cos(beta) ** 3)
        beta = np.arctan2((1 - p.flattening) * np.sin(phi), np.cos(phi))
    return np.degrees(np.arctan2(y, x)), np.degrees(phi)


def shifted(shift: Sequence[float], x, y, z, back: bool = False):
    """Geocentric places moved to WGS 84 by a shift of datum, or back from there, by the inverse of the same matrix."""
    dx, dy, dz, rx, ry, rz, ppm = (*shift, 0, 0, 0, 0)[:7]
    rx, ry, rz = (np.radians(r / 3600) for r in (rx, ry, rz))
    turn = (1 + ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    move, places = np.array([[dx], [dy], [dz]]), np.stack(np.broadcast_arrays(x, y, z)).reshape(3, -1)
    out = np.linalg.solve(turn, places - move) if back else turn @ places + move
    return tuple(out.reshape(3, *np.shape(x)))


def _to_own(p: Projection, lon, lat):
    if p.shift is None:
        return lon, lat
    return geodetic(p, *shifted(p.shift, *geocentric(WGS84, lon, lat), back=True))


def _to_wgs84(p: Projection, lon, lat):
    if p.shift is None:
        return lon, lat
    return geodetic(WGS84, *shifted(p.shift, *geocentric(p, lon, lat)))


def _m(p: Projection, phi):
    return np.cos(phi) / np.sqrt(1 - p.e2 * np.sin(phi) ** 2)


def _t(p: Projection, phi):
    s = p.e * np.sin(phi)
    return np.tan(np.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (p.e / 2)


def _latitude(p: Projection, t):
    """The latitude whose _t is t, by repeated substitution."""
    phi = np.pi / 2 - 2 * np.arctan(t)
    for _ in range(12):
        s = p.e * np.sin(phi)
        phi = np.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (p.e / 2))
    return phi


def _q(p: Projection, phi):
    s = np.sin(phi)
    if not p.e2:
        return 2 * s
    return (1 - p.e2) * (s / (1 - p.e2 * s**2) - np.log((1 - p.e * s) / (1 + p.e * s)) / (2 * p.e))


def _apart(p: Projection, lon):
    """Radians from the middle meridian, within half a turn."""
    return np.radians((np.asarray(lon, float) - p.lon0 + 180) % 360 - 180)


def _lambert(p: Projection):
    one, two = np.radians(p.lat1), np.radians(p.lat1 if p.lat2 is None else p.lat2)
    n = np.sin(one) if abs(one - two) < 1e-12 else (np.log(_m(p, one)) - np.log(_m(p, two))) / (np.log(_t(p, one)) - np.log(_t(p, two)))
    f = p.scale * p.axis * _m(p, one) / (n * _t(p, one) ** n)
    return n, f, f * _t(p, np.radians(p.lat0)) ** n


def _albers(p: Projection):
    one, two = np.radians(p.lat1), np.radians(p.lat1 if p.lat2 is None else p.lat2)
    n = np.sin(one) if abs(one - two) < 1e-12 else (_m(p, one) ** 2 - _m(p, two) ** 2) / (_q(p, two) - _q(p, one))
    c = _m(p, one) ** 2 + n * _q(p, one)
    return n, c, p.axis * np.sqrt(c - n * _q(p, np.radians(p.lat0))) / n


def _polar(p: Projection):
    """Which pole (1 north, -1 south), and the distance from it for a _t of 1."""
    south = p.lat0 < 0 if p.lat1 is None else p.lat1 < 0
    whole = np.sqrt((1 + p.e) ** (1 + p.e) * (1 - p.e) ** (1 - p.e))
    if p.lat1 is None or abs(abs(p.lat1) - 90) < 1e-12:
        return (-1 if south else 1), 2 * p.axis * p.scale / whole
    true = np.radians(abs(p.lat1))
    return (-1 if south else 1), p.axis * _m(p, true) / _t(p, true)


def _krueger(p: Projection):
    """The radius of the rectified meridian, and the series there and back to the fourth power of the third flattening."""
    n = p.flattening / (2 - p.flattening)
    radius = p.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return radius, there, back


def _rectified(p: Projection, lam, phi):
    """Northing and easting over the radius of a transverse Mercator projection."""
    t = np.sinh(np.arctanh(np.sin(phi)) - p.e * np.arctanh(p.e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    z = xi + 1j * eta
    z = z + sum(c * np.sin(2 * (k + 1) * z) for k, c in enumerate(_krueger(p)[1]))
    return z.real, z.imag


def forward(p: Projection, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """x and y of places in degrees on WGS 84, in the projection's unit."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    with np.errstate(all="ignore"):
        lon, lat = _to_own(p, lon, lat)
        if p.kind == "lonlat":
            return lon, lat
        lam, phi = _apart(p, lon), np.radians(lat)
        if p.kind == "transverse_mercator":
            radius, start = _krueger(p)[0] * p.scale, _rectified(p, np.zeros(1), np.full(1, np.radians(p.lat0)))[0][0]
            north, east = _rectified(p, lam, phi)
            x, y = radius * east, radius * (north - start)
        elif p.kind == "lambert_conformal":
            n, f, start = _lambert(p)
            r = f * _t(p, phi) ** n
            x, y = r * np.sin(n * lam), start - r * np.cos(n * lam)
        elif p.kind == "albers":
            n, c, start = _albers(p)
            r = p.axis * np.sqrt(c - n * _q(p, phi)) / n
            x, y = r * np.sin(n * lam), start - r * np.cos(n * lam)
        else:
            pole, one = _polar(p)
            r = one * _t(p, pole * phi)
            x, y = r * np.sin(lam), -pole * r * np.cos(lam)
        return (x + p.x0) / p.unit, (y + p.y0) / p.unit


def inverse(p: Projection, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees on WGS 84 of places in the projection."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    with np.errstate(all="ignore"):
        if p.kind == "lonlat":
            return _to_wgs84(p, x, y)
        x, y = x * p.unit - p.x0, y * p.unit - p.y0
        if p.kind == "transverse_mercator":
            radius, _, back = _krueger(p)
            radius, start = radius * p.scale, _rectified(p, np.zeros(1), np.full(1, np.radians(p.lat0)))[0][0]
            z = y / radius + start + 1j * x / radius
            z = z - sum(c * np.sin(2 * (k + 1) * z) for k, c in enumerate(back))
            conformal = np.arcsin(np.sin(z.real) / np.cosh(z.imag))
            lam, phi = np.arctan2(np.sinh(z.imag), np.cos(z.real)), _latitude(p, np.tan(np.pi / 4 - conformal / 2))
        elif p.kind == "lambert_conformal":
            n, f, start = _lambert(p)
            r = np.sign(n) * np.hypot(x, start - y)
            lam = np.arctan2(np.sign(n) * x, np.sign(n) * (start - y)) / n
            phi = np.where(r == 0, np.sign(n) * np.pi / 2, _latitude(p, (r / f) ** (1 / n)))
        elif p.kind == "albers":
            n, c, start = _albers(p)
            r = np.hypot(x, start - y)
            lam = np.arctan2(np.sign(n) * x, np.sign(n) * (start - y)) / n
            q = (c - (r * n / p.axis) ** 2) / n
            phi = np.arcsin(np.clip(q / 2, -1, 1))
            for _ in range(12):
                phi = phi + (1 - p.e2 * np.sin(phi) ** 2) ** 2 / (2 * np.cos(phi)) * (q - _q(p, phi)) / (1 - p.e2)
        else:
            pole, one = _polar(p)
            phi, lam = pole * _latitude(p, np.hypot(x, y) / one), np.arctan2(x, -pole * y)
        lon = (np.degrees(lam) + p.lon0 + 180) % 360 - 180
        return _to_wgs84(p, lon, np.degrees(phi))


def _columns(function, p: Projection, a: Column, b: Column) -> tuple[Column, Column]:
    @F.arrow_udf("a double, b double")
    def places(first: pa.Array, second: pa.Array) -> pa.Array:
        found = function(p, *(c.to_numpy(zero_copy_only=False).astype(float) for c in (first, second)))
        return pa.StructArray.from_arrays([pa.array(v, mask=~np.isfinite(v)) for v in found], ["a", "b"])

    made = places(a.cast("double"), b.cast("double"))
    return made["a"], made["b"]


def forward_columns(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of columns of degrees, null where there is no place."""
    return _columns(forward, p, lon, lat)


def inverse_columns(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of columns of places, null where there is none."""
    return _columns(inverse, p, x, y)


#: Fixed by the GeoTIFF format: codes of projection methods and of linear units.
GEO_METHODS = {1: "transverse_mercator", 8: "lambert_conformal", 9: "lambert_conformal", 11: "albers", 15: "polar_stereographic"}
GEO_UNITS = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}


def from_geokeys(directory: Sequence[int], doubles: Sequence[float] = ()) -> Projection | None:
    """The projection that a GeoTIFF file's key directory and double parameters describe; None where they name a known code alone, or a
    method that is not here. Origins may be natural or false ones; a geographic system may have its own ellipsoid and shift."""
    keys: dict[int, float | tuple[float, ...]] = {}
    for k in range(4, 4 + 4 * int(directory[3]), 4):
        key, place, count, value = (int(v) for v in directory[k : k + 4])
        if place == 0:
            keys[key] = float(value)
        elif place == 34736:
            own = tuple(float(v) for v in doubles[value : value + count])
            keys[key] = own[0] if count == 1 else own
    axis, inverse_flattening = keys.get(2057, 6378137.0), keys.get(2059)
    if inverse_flattening is None:
        inverse_flattening = axis / (axis - keys[2058]) if keys.get(2058, axis) != axis else 0.0 if 2058 in keys else 298.257223563
    earth = {"axis": axis, "inverse_flattening": inverse_flattening, "shift": keys.get(2062)}
    kind = GEO_METHODS.get(int(keys.get(3075, 0)))
    if kind is None:
        return Projection("lonlat", **earth) if keys.get(1024) == 2 and 2057 in keys else None

    def first(*names: int, default: float | None = 0.0) -> float | None:
        return next((keys[n] for n in names if n in keys), default)

    one, two = first(3078, default=None), first(3079, default=None)
    lat0 = first(3081, 3085, 3089)
    if kind == "lambert_conformal" and one is None:
        one = lat0
    if kind == "polar_stereographic":
        # The natural origin's latitude is the pole, or the parallel of true scale.
        one, lat0 = (None, lat0) if abs(abs(lat0) - 90) < 1e-9 else (lat0, 90.0 if lat0 > 0 else -90.0)
        two = None
    unit = GEO_UNITS.get(int(keys.get(3076, 9001)), keys.get(3077, 1.0))
    x0, y0 = first(3082, 3086, 3090) * unit, first(3083, 3087, 3091) * unit
    return Projection(kind, lon0=first(3080, 3084, 3088, 3095), lat0=lat0, lat1=one, lat2=two, scale=first(3092, 3093, default=1.0), x0=x0, y0=y0, unit=unit, **earth)


def from_parameters(values: Mapping[str, object]) -> Projection:
    """A projection from a row or a configuration: fields of Projection, or `ellipsoid`, a name among ELLIPSOIDS, for the earth's."""
    own = {k: v for k, v in values.items() if v is not None}
    if name := own.pop("ellipsoid", None):
        own["axis"], own["inverse_flattening"] = ELLIPSOIDS[str(name)]
    if "shift" in own:
        own["shift"] = tuple(own["shift"])
    return Projection(**own)

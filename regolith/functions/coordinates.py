"""Coordinate systems as column expressions: longitude and latitude (EPSG 4326), web Mercator (3857) and the UTM zones on WGS 84
(32601 to 32660 north, 32701 to 32760 south). Between two projections, make longitude and latitude columns of their own (see
operators.spatial.warped): the expression of both together would repeat parts thousands of times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: WGS 84's semi-major axis and flattening; UTM's scale, false easting and false northing in the south.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = 2 * _N**0.5 / (1 + _N)
RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Fixed: Krueger's series of the transverse Mercator projection, to the fourth power of the third flattening: there, and back, and
#: from the conformal to the geographic latitude.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _series(terms: Sequence[float], of: Column) -> Column:
    """The sum of terms[j] * sin(2 (j + 1) of)."""
    return sum((c * F.sin(2 * (j + 1) * of) for j, c in enumerate(terms)), F.lit(0.0))


def _complex(terms: Sequence[float], north: Column, east: Column) -> tuple[Column, Column]:
    """The same sum over the complex number north + i east: its real and its imaginary part."""
    angles = [(c, 2 * (j + 1) * north, 2 * (j + 1) * east) for j, c in enumerate(terms)]
    return sum((c * F.sin(a) * F.cosh(b) for c, a, b in angles), F.lit(0.0)), sum((c * F.cos(a) * F.sinh(b) for c, a, b in angles), F.lit(0.0))


def _code(epsg: Column | int) -> Column:
    return F.lit(epsg) if isinstance(epsg, int) else epsg


def _utm(code: Column) -> tuple[Column, Column, Column]:
    """Whether a code is of a UTM zone, the zone's middle meridian in degrees, and its false northing."""
    zone = code % 100
    return F.floor(code / 100).isin(326, 327) & zone.between(1, 60), zone * 6 - 183.0, F.when(F.floor(code / 100) == 327, SOUTH).otherwise(0.0)


def from_lonlat(epsg: Column | int, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of degrees in a coordinate system; null in any other than those that the module names. UTM is right to a millimetre
    within some degrees of its zone."""
    code = _code(epsg)
    utm, middle, false_north = _utm(code)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    apart = F.radians(lon - middle)
    north, east = F.atan2(t, F.cos(apart)), F.atanh(F.sin(apart) / F.sqrt(1 + t * t))
    more_north, more_east = _complex(ALPHA, north, east)
    mercator = AXIS * F.log(F.tan(F.radians(45 + lat / 2)))
    x = F.when(code == 4326, lon).when(code == 3857, AXIS * F.radians(lon)).when(utm, EAST + RADIUS * (east + more_east))
    y = F.when(code == 4326, lat).when(code == 3857, mercator).when(utm, false_north + RADIUS * (north + more_north))
    return x, y


def to_lonlat(epsg: Column | int, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in a coordinate system; null in any other than those that the module names."""
    code = _code(epsg)
    utm, middle, false_north = _utm(code)
    north, east = (y - false_north) / RADIUS, (x - EAST) / RADIUS
    less_north, less_east = _complex(BETA, north, east)
    north, east = north - less_north, east - less_east
    conformal = F.asin(F.sin(north) / F.cosh(east))
    lat = F.degrees(conformal + _series(DELTA, conformal))
    lon = middle + F.degrees(F.atan2(F.sinh(east), F.cos(north)))
    lon = F.when(code == 4326, x).when(code == 3857, F.degrees(x / AXIS)).when(utm, lon)
    lat = F.when(code == 4326, y).when(code == 3857, F.degrees(2 * F.atan(F.exp(y / AXIS))) - 90).when(utm, lat)
    return lon, lat

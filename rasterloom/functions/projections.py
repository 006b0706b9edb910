"""Longitude and latitude, web Mercator and transverse Mercator (UTM) on WGS 84, both ways, as column expressions.

Transverse Mercator is the series in the third flattening to its sixth power, right to well
below a millimetre within the zones' neighbours.  Coordinates outside of a system's range give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid, and the zones' scale and false origin.  Fixed values.
A, FLAT, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_E = math.sqrt(FLAT * (2 - FLAT))
_N = FLAT / (2 - FLAT)
_RECTIFIED = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Row j holds the factors of n to the powers j, j + 1 and so on."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


#: Factors of the series: to the plane, back from it, and from conformal to geographic latitude.  Fixed values.
_TO = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))
_FROM = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))
_LATITUDE = _series((2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835), (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of values that are made once, however often it names them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def code(crs: Column) -> Column:
    """The number of an ``EPSG:`` name; null for others."""
    return F.regexp_extract(F.upper(crs), r"^EPSG:(\d{1,6})$", 1).try_cast("int")


def _meridian(number: Column) -> Column:
    return F.radians((number % 100) * 6 - 183)


def _is_zone(number: Column) -> Column:
    return number.between(32601, 32660) | number.between(32701, 32760)


def _wrapped(angle: Column) -> Column:
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def _into_zone(number: Column, lon: Column, lat: Column) -> Column:
    """Easting and northing; null more than 80 degrees off the meridian."""

    def plane(v: Column) -> Column:
        conformal = F.sin(v["lat"])
        sigma = F.sinh(_E * F.atanh(_E * conformal))
        tau = F.tan(v["lat"])
        return _let({"t": tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau), "l": v["l"]}, lambda w: _let({"xi": F.atan2(w["t"], F.cos(w["l"])), "eta": F.asinh(F.sin(w["l"]) / F.sqrt(w["t"] * w["t"] + F.cos(w["l"]) * F.cos(w["l"])))}, series))

    def series(w: Column) -> Column:
        xi = w["xi"] + sum((a * F.sin(2 * j * w["xi"]) * F.cosh(2 * j * w["eta"]) for j, a in enumerate(_TO, 1)), F.lit(0.0))
        eta = w["eta"] + sum((a * F.cos(2 * j * w["xi"]) * F.sinh(2 * j * w["eta"]) for j, a in enumerate(_TO, 1)), F.lit(0.0))
        return _point(EAST + SCALE * _RECTIFIED * eta, SCALE * _RECTIFIED * xi + F.when(number >= 32700, NORTH).otherwise(0.0))

    off = _wrapped(F.radians(lon) - _meridian(number))
    return F.when((F.abs(lat) <= 90) & (F.abs(off) <= math.radians(80)), _let({"lat": F.radians(lat), "l": off}, plane))


def _out_of_zone(number: Column, x: Column, y: Column) -> Column:
    def sphere(v: Column) -> Column:
        xi = v["xi"] - sum((b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"]) for j, b in enumerate(_FROM, 1)), F.lit(0.0))
        eta = v["eta"] - sum((b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"]) for j, b in enumerate(_FROM, 1)), F.lit(0.0))
        return _let({"xi": xi, "eta": eta}, lambda w: _let({"chi": F.asin(F.sin(w["xi"]) / F.cosh(w["eta"])), "l": F.atan2(F.sinh(w["eta"]), F.cos(w["xi"]))}, geographic))

    def geographic(w: Column) -> Column:
        lat = w["chi"] + sum((d * F.sin(2 * j * w["chi"]) for j, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
        return _point(F.degrees(_wrapped(w["l"] + _meridian(number))), F.degrees(lat))

    north = y - F.when(number >= 32700, NORTH).otherwise(0.0)
    values = {"xi": north / (SCALE * _RECTIFIED), "eta": (x - EAST) / (SCALE * _RECTIFIED)}
    return F.when((F.abs(values["xi"]) <= math.pi / 2) & (F.abs(values["eta"]) <= 1.5), _let(values, sphere))


def to_lonlat(crs: Column, x: Column, y: Column) -> Column:
    """struct<x, y>: longitude and latitude in degrees; null for an unknown system or a place outside of it."""
    number = code(crs)
    plain = F.when((F.abs(y) <= 90) & (F.abs(x) <= 360), _point(x, y))
    web = F.when(F.abs(x) <= 2 * math.pi * A, _point(F.degrees(x / A), F.degrees(F.atan(F.sinh(y / A)))))
    return F.when(number == 4326, plain).when(number == 3857, web).when(_is_zone(number), _out_of_zone(number, x, y))


def from_lonlat(crs: Column, lon: Column, lat: Column) -> Column:
    """struct<x, y> in the system; null for an unknown one or a place outside of it."""
    number = code(crs)
    web = F.when(F.abs(lat) < 90, _point(A * F.radians(lon), A * F.asinh(F.tan(F.radians(lat)))))
    return F.when(number == 4326, _point(lon, lat)).when(number == 3857, web).when(_is_zone(number), _into_zone(number, lon, lat))


def transformed(source: Column, target: Column, points: Column) -> Column:
    """array<struct<x, y>> of another system; a point that can't be transformed is null."""
    lonlat = F.transform(points, lambda p: to_lonlat(source, p["x"], p["y"]))
    return F.transform(lonlat, lambda p: F.when(p.isNotNull(), from_lonlat(target, p["x"], p["y"])))


def bounds(source: Column, target: Column, box: tuple[Column, Column, Column, Column], between: int = 21) -> Column:
    """struct<x0, y0, x1, y1> of a rectangle in another system, from its corners and ``between`` points on each edge; null if one fails."""
    x0, y0, x1, y1 = box
    shares = F.transform(F.sequence(F.lit(0), F.lit(between + 1)), lambda i: i / F.lit(between + 1.0))
    edges = F.flatten(F.transform(shares, lambda s: F.array(_point(x0 + s * (x1 - x0), y0), _point(x0 + s * (x1 - x0), y1), _point(x0, y0 + s * (y1 - y0)), _point(x1, y0 + s * (y1 - y0)))))

    def ends(v: Column) -> Column:
        xs, ys = F.transform(v["p"], lambda p: p["x"]), F.transform(v["p"], lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))

    return _let({"p": transformed(source, target, edges)}, lambda v: F.when(F.forall(v["p"], lambda p: p.isNotNull()), ends(v)))

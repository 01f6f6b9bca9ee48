"""Distance between venues and stations on the WGS-84 ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84 semi-major axis (m) and flattening.
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563

# Venue coordinates (latitude, longitude).
VENUES = {
    "Ziggo Dome": (52.313522864427696, 4.9371839278273875),
    "Endemol": (52.31535991263321, 4.934918212484825),
    "AFAS Live": (52.31208301885852, 4.944499883649119),
    "De Toekomst": (52.31302103804334, 4.928368425789856),
    "Arena": (52.31452213292746, 4.94193191229651),
    "Gaasperplas": (52.3929282804607, 4.902166515382845),
    "Paradiso": (52.36241084594603, 4.8839668313372515),
    "Afas Live": (52.31198463100763, 4.9445106122964555),
    "Olympisch Stadion": (52.34344264336677, 4.853012827639222),
    "Melkweg": (52.36483839071882, 4.881184525790839),
    "Royal Theater Carré": (52.36241338668293, 4.90423151229743),
    "Beurs van Berlage": (52.375140777876005, 4.896203485310937),
    "Concertgebouw": (52.35645333735133, 4.8790282122973085),
    "De Waalse Kerk": (52.37110648416711, 4.897230269968681),
    "Lovelee": (52.36487084204627, 4.881842227639652),
}

# Station coordinates (latitude, longitude).
STATION_POINTS = {
    "Centraal Station": (52.379338119590415, 4.9001788162610875),
    "Station Zuid": (52.33988258200082, 4.873346017322016),
    "Station Bijlmer ArenA": (52.311700953723935, 4.947731485309759),
}


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _terms(lam: str) -> str:
    """Spherical terms of the point pair ``p`` for a longitude difference ``lam``."""
    sigma = f"""struct(
        sqrt(pow(p.c2 * sin({lam}), 2) + pow(p.c1 * p.s2 - p.s1 * p.c2 * cos({lam}), 2)) AS ss,
        p.s1 * p.s2 + p.c1 * p.c2 * cos({lam}) AS cs)"""
    azimuth = f"coalesce(try_divide(p.c1 * p.c2 * sin({lam}), q.ss), 0D)"
    return _let("q", sigma, _let("sa", azimuth, """struct(
        q.ss AS ss, q.cs AS cs, atan2(q.ss, q.cs) AS sigma, sa AS sa, 1 - sa * sa AS c2a,
        coalesce(q.cs - try_divide(2 * p.s1 * p.s2, 1 - sa * sa), 0D) AS cm)"""))


def geodesic_km(lat1: str, lon1: str, lat2: str, lon2: str, rounds: int = 12) -> Column:
    """Vincenty's inverse formula (1975) over four columns, iterated in one expression.

    ``rounds`` steps are far more than needed at city distances; nearly antipodal
    points, where the series does not settle, are outside its use here.
    """
    f = FLATTENING
    minor = AXIS * (1 - f)
    second = (AXIS**2 - minor**2) / minor**2

    def reduced(lat: str) -> str:
        return f"atan({1 - f}D * tan(radians({lat})))"

    pair = f"""struct(
        sin({reduced(lat1)}) AS s1, cos({reduced(lat1)}) AS c1,
        sin({reduced(lat2)}) AS s2, cos({reduced(lat2)}) AS c2, radians({lon2} - {lon1}) AS lon)"""
    correction = f"{f / 16}D * t.c2a * (4 + {f}D * (4 - 3 * t.c2a))"
    step = _let("t", _terms("lam"), _let("c", correction, f"""
        p.lon + (1 - c) * {f}D * t.sa
          * (t.sigma + c * t.ss * (t.cm + c * t.cs * (2 * t.cm * t.cm - 1)))"""))
    settled = f"aggregate(sequence(1, {rounds}), p.lon, (lam, i) -> {step})"
    series = """struct(
        1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS a,
        u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS b)"""
    delta = """w.b * t.ss * (t.cm + w.b / 4 * (t.cs * (2 * t.cm * t.cm - 1)
        - w.b / 6 * t.cm * (4 * t.ss * t.ss - 3) * (4 * t.cm * t.cm - 3)))"""
    length = _let("u", f"{second}D * t.c2a", _let("w", series, f"{minor / 1000}D * w.a * (t.sigma - {delta})"))
    return F.expr(_let("p", pair, _let("l", settled, _let("t", _terms("l"), length))))


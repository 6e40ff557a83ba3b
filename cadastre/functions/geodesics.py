"""Shortest lines on the ellipsoid, both ways, by the nested series in terms of the reduced latitude, iterated inside the expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastre.functions.geodesy import AXIS, FLATTENING
from cadastre.functions.rings import let

#: The lesser half axis.
MINOR = AXIS * (1 - FLATTENING)
#: Iterations at most, and the change (radians) at which they end.
TURNS, CLOSE = 200, 1e-12
#: Iterations of all lines; few lines need the others.
FEW = 4


def _with(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), f)


def _iterated(start: Column, turn: Callable[[Column], Column]) -> Column:
    """The state after at most TURNS turns, from which those of a state that is done are left out but for the first FEW."""
    on = lambda state, first, last: F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, lambda now, _: turn(now))
    return let(on(start, 1, FEW), lambda state: F.when(state["done"], state).otherwise(on(state, FEW + 1, TURNS)))


def _reduced(lat: Column) -> Column:
    return F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))


def _degrees(angle: Column) -> Column:
    return F.pmod(F.degrees(angle), F.lit(360.0))


def _scale(cos2: Column) -> tuple[Column, Column]:
    """The series A and B for the square of the cosine of the line's azimuth at the equator."""
    u = cos2 * (AXIS**2 - MINOR**2) / MINOR**2
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _bend(b: Column, sin: Column, cos: Column, mid: Column) -> Column:
    """By how much the arc on the sphere differs: sin, cos of the arc and the cosine of twice its middle."""
    return b * sin * (mid + b / 4 * (cos * (-1 + 2 * mid * mid) - b / 6 * mid * (-3 + 4 * sin * sin) * (-3 + 4 * mid * mid)))


def geodesic_inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """struct(distance, bearing, back) of the line between two points, in metres and degrees; back is the bearing from the second to the first.

    Points in one place have distance 0, bearing 0 and back 180.  Where the
    iteration doesn't end (points almost opposite each other on the
    ellipsoid, within about half a degree) all three are null.
    """
    along = F.pmod(F.radians(lon2 - lon1) + F.pi(), 2 * F.pi()) - F.pi()

    def solve(p: Column) -> Column:
        su, cu, sv, cv = F.sin(p["u"]), F.cos(p["u"]), F.sin(p["v"]), F.cos(p["v"])

        def arc(lam: Column, f: Callable[[Column], Column]) -> Column:
            across, up = cv * F.sin(lam), cu * sv - su * cv * F.cos(lam)
            return _with({"sin": F.sqrt(across * across + up * up), "cos": su * sv + cu * cv * F.cos(lam), "lam": lam}, f)

        def more(a: Column, f: Callable[[Column], Column]) -> Column:
            slant = F.coalesce(F.try_divide(cu * cv * F.sin(a["lam"]), a["sin"]), F.lit(0.0))
            cos2 = 1 - slant * slant
            mid = F.when(cos2 > 1e-15, a["cos"] - F.try_divide(2 * su * sv, cos2)).otherwise(0.0)
            return _with({"sin": a["sin"], "cos": a["cos"], "lam": a["lam"], "arc": F.atan2(a["sin"], a["cos"]), "slant": slant, "cos2": cos2, "mid": mid}, f)

        def turn(state: Column) -> Column:
            def next_(m: Column) -> Column:
                c = FLATTENING / 16 * m["cos2"] * (4 + FLATTENING * (4 - 3 * m["cos2"]))
                lam = p["l"] + (1 - c) * FLATTENING * m["slant"] * (m["arc"] + c * m["sin"] * (m["mid"] + c * m["cos"] * (-1 + 2 * m["mid"] * m["mid"])))
                return let(lam, lambda new: F.struct(new.alias("lam"), (F.abs(new - state["lam"]) <= CLOSE).alias("done")))

            return F.when(state["done"], state).otherwise(arc(state["lam"], lambda a: more(a, next_)))

        def result(m: Column) -> Column:
            a, b = _scale(m["cos2"])
            lam = m["lam"]
            ahead = F.atan2(cv * F.sin(lam), cu * sv - su * cv * F.cos(lam))
            back = F.atan2(cu * F.sin(lam), cu * sv * F.cos(lam) - su * cv) + F.pi()
            same = m["sin"] < 1e-15
            return F.struct(
                F.when(same, 0.0).otherwise(MINOR * a * (m["arc"] - _bend(b, m["sin"], m["cos"], m["mid"]))).alias("distance"),
                F.when(same, 0.0).otherwise(_degrees(ahead)).alias("bearing"),
                F.when(same, 180.0).otherwise(_degrees(back)).alias("back"),
            )

        start = F.struct(p["l"].alias("lam"), F.lit(False).alias("done"))
        return let(_iterated(start, turn), lambda e: F.when(e["done"] & (F.abs(e["lam"]) <= F.pi()), arc(e["lam"], lambda a: more(a, result))))

    return _with({"u": _reduced(lat1), "v": _reduced(lat2), "l": along}, solve)


def geodesic_forward(lon: Column, lat: Column, bearing: Column, distance: Column) -> Column:
    """struct(lon, lat, back): where a line of that bearing (degrees) and length (metres) ends, and the bearing back."""

    def solve(p: Column) -> Column:
        def turn(state: Column) -> Column:
            arc, mid = state["arc"], F.cos(2 * p["first"] + state["arc"])
            new = p["even"] + _bend(p["b"], F.sin(arc), F.cos(arc), mid)
            return F.when(state["done"], state).otherwise(let(new, lambda n: F.struct(n.alias("arc"), (F.abs(n - arc) <= CLOSE).alias("done"))))

        def result(e: Column) -> Column:
            sin, cos, mid = F.sin(e["arc"]), F.cos(e["arc"]), F.cos(2 * p["first"] + e["arc"])
            su, cu, sa, ca = F.sin(p["u"]), F.cos(p["u"]), F.sin(p["az"]), F.cos(p["az"])
            down = su * sin - cu * cos * ca
            lat2 = F.atan2(su * cos + cu * sin * ca, (1 - FLATTENING) * F.sqrt(p["slant"] * p["slant"] + down * down))
            lam = F.atan2(sin * sa, cu * cos - su * sin * ca)
            c = FLATTENING / 16 * p["cos2"] * (4 + FLATTENING * (4 - 3 * p["cos2"]))
            along = lam - (1 - c) * FLATTENING * p["slant"] * (e["arc"] + c * sin * (mid + c * cos * (-1 + 2 * mid * mid)))
            return F.struct((F.pmod(lon + F.degrees(along) + 180, F.lit(360.0)) - 180).alias("lon"), F.degrees(lat2).alias("lat"), _degrees(F.atan2(p["slant"], -down) + F.pi()).alias("back"))

        start = F.struct(p["even"].alias("arc"), F.lit(False).alias("done"))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, lambda state, _: turn(state)), result)

    def prepared(p: Column) -> Column:
        slant = F.cos(p["u"]) * F.sin(p["az"])
        cos2 = 1 - slant * slant
        a, b = _scale(cos2)
        return _with({"u": p["u"], "az": p["az"], "slant": slant, "cos2": cos2, "b": b, "even": distance / (MINOR * a), "first": F.atan2(F.tan(p["u"]), F.cos(p["az"]))}, solve)

    return _with({"u": _reduced(lat), "az": F.radians(bearing)}, prepared)


def forward_arrays(lon: np.ndarray, lat: np.ndarray, bearing: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) of the ends of many lines, as by geodesic_forward(), for walks whose lines begin where others end."""
    u, az = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat))), np.radians(bearing)
    su, cu, sa, ca = np.sin(u), np.cos(u), np.sin(az), np.cos(az)
    slant = cu * sa
    cos2 = 1 - slant * slant
    a, b = _scale(cos2)
    even, first = distance / (MINOR * a), np.arctan2(np.tan(u), ca)
    arc, open_ = even.copy(), np.flatnonzero(~np.isnan(even + first))
    for _ in range(TURNS):
        if not len(open_):
            break
        now = arc[open_]
        arc[open_] = even[open_] + _bend(b[open_], np.sin(now), np.cos(now), np.cos(2 * first[open_] + now))
        open_ = open_[~(np.abs(arc[open_] - now) <= CLOSE)]
    sin, cos, mid = np.sin(arc), np.cos(arc), np.cos(2 * first + arc)
    down = su * sin - cu * cos * ca
    lam, c = np.arctan2(sin * sa, cu * cos - su * sin * ca), FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    along = lam - (1 - c) * FLATTENING * slant * (arc + c * sin * (mid + c * cos * (-1 + 2 * mid * mid)))
    return np.mod(lon + np.degrees(along) + 180, 360.0) - 180, np.degrees(np.arctan2(su * cos + cu * sin * ca, (1 - FLATTENING) * np.sqrt(slant * slant + down * down)))


def inverse_arrays(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, bearing) of many lines, as by geodesic_inverse(); NaN where that has null."""
    u, v = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    along = np.mod(np.radians(lon2 - lon1) + np.pi, 2 * np.pi) - np.pi
    su, cu, sv, cv = np.sin(u), np.cos(u), np.sin(v), np.cos(v)

    def middle(lam: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        across, up = cv[at] * np.sin(lam), cu[at] * sv[at] - su[at] * cv[at] * np.cos(lam)
        sin, cos = np.sqrt(across * across + up * up), su[at] * sv[at] + cu[at] * cv[at] * np.cos(lam)
        slant = np.divide(cu[at] * cv[at] * np.sin(lam), sin, out=np.zeros_like(sin), where=sin != 0)
        cos2 = 1 - slant * slant
        mid = np.where(cos2 > 1e-15, cos - np.divide(2 * su[at] * sv[at], cos2, out=np.zeros_like(sin), where=cos2 != 0), 0.0)
        return sin, cos, np.arctan2(sin, cos), slant, cos2, mid, across, up

    lam, open_ = along.copy(), np.flatnonzero(~np.isnan(along + u + v))
    for _ in range(TURNS):
        if not len(open_):
            break
        now = lam[open_]
        sin, cos, arc, slant, cos2, mid, _, _ = middle(now, open_)
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        lam[open_] = along[open_] + (1 - c) * FLATTENING * slant * (arc + c * sin * (mid + c * cos * (-1 + 2 * mid * mid)))
        open_ = open_[~(np.abs(lam[open_] - now) <= CLOSE)]
    lam[open_] = np.nan
    lam[np.abs(lam) > np.pi] = np.nan
    sin, cos, arc, slant, cos2, mid, across, up = middle(lam, np.arange(len(lam)))
    a, b = _scale(cos2)
    same = sin < 1e-15
    return np.where(same, 0.0, MINOR * a * (arc - _bend(b, sin, cos, mid))), np.where(same, 0.0, np.mod(np.degrees(np.arctan2(across, up)), 360.0))

"""Coordinate geometry as Column expressions.

Azimuths are radians clockwise from north (+y), in [0, 2 pi); distances metres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def azimuth(angle: Column) -> Column:
    """The angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(TWO_PI))


def back_azimuth(az: Column) -> Column:
    return azimuth(az + F.pi())


def azimuth_difference(a: Column, b: Column) -> Column:
    """a - b, signed, in (-pi, pi]."""
    d = F.pmod(a - b, F.lit(TWO_PI))
    return F.when(d > F.pi(), d - TWO_PI).otherwise(d)


def departure(az: Column, d: Column) -> Column:
    return d * F.sin(az)


def latitude(az: Column, d: Column) -> Column:
    return d * F.cos(az)


def inverse(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance and azimuth from the first point to the second."""
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy), azimuth(F.atan2(dx, dy))


def ray_ray(x1: Column, y1: Column, az1: Column, x2: Column, y2: Column, az2: Column) -> tuple[Column, Column]:
    """Where two rays' lines cross; null if they are parallel (determinant under 1e-12)."""
    det = F.sin(az1) * -F.cos(az2) + F.cos(az1) * F.sin(az2)
    t = ((x2 - x1) * -F.cos(az2) + (y2 - y1) * F.sin(az2)) / F.when(F.abs(det) >= 1e-12, det)
    return x1 + t * F.sin(az1), y1 + t * F.cos(az1)


def ray_circle(x: Column, y: Column, az: Column, cx: Column, cy: Column, r: Column) -> tuple[Column, Column]:
    """Distances t1 <= t2 along a ray to a circle; null if it misses."""
    dx, dy = x - cx, y - cy
    half = dx * F.sin(az) + dy * F.cos(az)
    inside = half * half - (dx * dx + dy * dy - r * r)
    root = F.sqrt(F.when(inside >= 0, inside))
    return -half - root, -half + root


def circle_circle(x1: Column, y1: Column, r1: Column, x2: Column, y2: Column, r2: Column) -> tuple[Column, Column, Column, Column]:
    """Both crossings of two circles; null for none or for one centre."""
    d, _ = inverse(x1, y1, x2, y2)
    a = (r1 * r1 - r2 * r2 + d * d) / (2 * F.when(d > 0, d))
    h2 = r1 * r1 - a * a
    h = F.sqrt(F.when(h2 >= 0, h2))
    mx, my = x1 + a * (x2 - x1) / d, y1 + a * (y2 - y1) / d
    return mx + h * (y2 - y1) / d, my - h * (x2 - x1) / d, mx - h * (y2 - y1) / d, my + h * (x2 - x1) / d


def dms(angle: Column) -> tuple[Column, Column, Column]:
    """Degrees, minutes and seconds (to 1/1000) of an angle in radians."""
    thousandths = F.round(F.degrees(F.abs(angle)) * 3_600_000).cast("long")
    return F.expr("1") * F.floor(thousandths / 3_600_000), F.floor(F.pmod(thousandths, F.lit(3_600_000)) / 60_000), F.pmod(thousandths, F.lit(60_000)) / 1000.0


def quadrant_bearing(az: Column) -> tuple[Column, Column, Column]:
    """(N or S, angle in [0, pi / 2], E or W) of an azimuth."""
    ns = F.when((az <= F.pi() / 2) | (az >= 3 * F.pi() / 2), "N").otherwise("S")
    ew = F.when(az <= F.pi(), "E").otherwise("W")
    angle = F.when(az <= F.pi() / 2, az).when(az <= F.pi(), F.pi() - az).when(az <= 3 * F.pi() / 2, az - F.pi()).otherwise(TWO_PI - az)
    return ns, angle, ew


def curve(radius: Column, delta: Column) -> dict[str, Column]:
    """Elements of a circular curve with central angle delta; null unless radius > 0 and 0 < delta < 2 pi."""
    ok = (radius > 0) & (delta > 0) & (delta < TWO_PI)
    r = F.when(ok, radius)
    return {
        "arc": r * delta,
        "chord": 2 * r * F.sin(delta / 2),
        "tangent": r * F.tan(delta / 2),
        "mid_ordinate": r * (1 - F.cos(delta / 2)),
        "external": r * (1 / F.cos(delta / 2) - 1),
        "degree": F.degrees(F.lit(30.48) / r),
    }


#: Metres of a unit by its spelling.
UNITS = {
    "ft": 0.3048, "feet": 0.3048, "foot": 0.3048, "us_ft": 1200 / 3937, "usft": 1200 / 3937, "us_survey_feet": 1200 / 3937,
    "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "ch": 20.1168, "chain": 20.1168, "chains": 20.1168,
    "li": 0.201168, "link": 0.201168, "links": 0.201168, "rd": 5.0292, "rod": 5.0292, "rods": 5.0292, "perch": 5.0292, "vara": 0.847396, "varas": 0.847396,
}
#: Least closure ratio of each standard.
STANDARDS = {"first_order": 100_000, "second_order": 50_000, "alta_nsps": 15_000, "third_order": 10_000, "urban": 7_500, "suburban": 5_000, "rural": 2_500, "construction": 1_000}

"""Geodetic columns: great circles, ring areas, tidal heights, the sun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.cogo import azimuth
from cadastre.functions.rings import let

RADIUS = 6378137.0
#: Metres of each tidal datum above NAVD88, by coastal region.
TIDES = {
    "Atlantic": {"mllw": -0.32, "msl": 0.05, "mhhw": 0.40},
    "Gulf": {"mllw": -0.20, "msl": 0.04, "mhhw": 0.25},
    "Pacific": {"mllw": -1.10, "msl": 0.10, "mhhw": 1.30},
    "Alaska": {"mllw": -2.40, "msl": 0.10, "mhhw": 2.80},
    "Hawaii": {"mllw": -0.30, "msl": 0.00, "mhhw": 0.30},
}
#: Regions by box (west, east, south, north), first match wins.
REGIONS = (("Alaska", -180, -130, 40, 75), ("Hawaii", -161, -154, 18, 23), ("Pacific", -130, -114, -90, 90), ("Gulf", -100, -80, 24, 31))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres; degrees in."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def initial_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Azimuth in radians at the first point; degrees in."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return azimuth(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def coastal_region(lon: Column, lat: Column) -> Column:
    out = F.lit("Atlantic")
    for name, west, east, south, north in reversed(REGIONS):
        out = F.when(lon.between(west, east) & lat.between(south, north), name).otherwise(out)
    return out


def tidal_height(region: Column, datum: str, height: Column) -> Column:
    """Height above a tidal datum from one above NAVD88; unknown regions have no offset."""
    offset = F.lit(0.0)
    for name, by in TIDES.items():
        offset = F.when(region == name, by[datum]).otherwise(offset)
    return height - offset


def sun_position(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Altitude and azimuth of the sun in degrees at a UTC time (low-precision almanac series)."""
    return _from_sky(*_sky(ts), lat, lon)


def _sky(ts: Column) -> tuple[Column, Column, Column]:
    """The sun's right ascension and declination in radians, and the sidereal time at longitude 0 in hours, not reduced."""
    d = (F.unix_micros(ts) / 1e6 - 946728000.0) / 86400.0
    g, mean = F.radians(F.pmod(357.529 + 0.98560028 * d, F.lit(360.0))), F.radians(F.pmod(280.459 + 0.98564736 * d, F.lit(360.0)))
    ecliptic = mean + F.radians(F.lit(1.915)) * F.sin(g) + F.radians(F.lit(0.020)) * F.sin(2 * g)
    tilt = F.radians(23.439 - 0.00000036 * d)
    ascension, declination = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic)), F.asin(F.sin(tilt) * F.sin(ecliptic))
    return ascension, declination, F.pmod(18.697374558 + 24.06570982441908 * d, F.lit(24.0))


def _from_sky(ascension: Column, declination: Column, sidereal: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    hour = F.radians((sidereal + lon / 15.0) * 15.0) - ascension
    phi = F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    az = F.atan2(-F.sin(hour) * F.cos(declination), F.cos(phi) * F.sin(declination) - F.sin(phi) * F.cos(declination) * F.cos(hour))
    return F.degrees(altitude), F.pmod(F.degrees(az), F.lit(360.0))


def with_sun(rows: DataFrame) -> DataFrame:
    """rows(ts, lat, lon, ..) with altitude and azimuth as by sun_position(), each part computed once for a row.

    Struct by struct, as a condition on columns would be computed with all of their parts wherever it names them.
    """

    def computed(df: DataFrame, *names: str, by: tuple[Column, ...]) -> DataFrame:
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip(names, by, strict=True)]))))

    sky = computed(rows, "_ascension", "_declination", "_sidereal", by=_sky(F.col("ts")))
    found = computed(sky, "altitude", "azimuth", by=_from_sky(F.col("_ascension"), F.col("_declination"), F.col("_sidereal"), F.col("lat"), F.col("lon")))
    return found.drop("_ascension", "_declination", "_sidereal")


def lonlat_area(ring: Column) -> Column:
    """Spherical-excess area, in square metres, of a closed ring of struct(x = lon, y = lat) in degrees; 0 for fewer than four points."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
    excess = F.aggregate(edges, F.lit(0.0), lambda s, e: s + F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"]))))
    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(F.abs(excess) * RADIUS * RADIUS / 2)


def lonlat_perimeter(ring: Column) -> Column:
    """Great-circle length of a ring of struct(x = lon, y = lat)."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + haversine(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def arc_points(x: Column, y: Column, radius: Column, begin: Column, end: Column, segments: int = 48) -> Column:
    """Array of struct(x, y) along an arc, counter-clockwise from one angle to the other; an end before the begin wraps round."""
    turn = F.when(end < begin, F.lit(6.283185307179586)).otherwise(0.0)

    # The span once for an arc, and an angle once for both coordinates.
    def along(k: Column) -> Column:
        angles = F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: k["b"] + k["s"] * i / segments)
        return F.transform(angles, lambda at: F.struct((k["x"] + k["r"] * F.cos(at)).alias("x"), (k["y"] + k["r"] * F.sin(at)).alias("y")))

    return let(F.struct(begin.alias("b"), (end - begin + turn).alias("s"), x.alias("x"), y.alias("y"), radius.alias("r")), along)


def circle_points(x: Column, y: Column, radius: Column, segments: int = 64) -> Column:
    return arc_points(x, y, radius, F.lit(0.0), F.lit(6.283185307179586), segments)


#: Half axis and flattening of the ellipsoid, and the scale on a zone's middle line.
AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(zone, easting, northing) by Krüger's series to the third order; northings south of the equator count from 10,000 km."""
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    zone = F.floor((lon + 180) / 6) + 1
    away, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    e = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = eta + sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    north = xi + sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return zone, 500_000 + SCALE * a * east, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + SCALE * a * north

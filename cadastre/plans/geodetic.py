"""Queries of lines and traverses on the ellipsoid: customers are sites, orders' line items are legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import geodesics
from cadastre.operators import geodetic
from cadastre.plans import bindings as B
from cadastre.plans.registry import query

_F = "(1 / 298.257223563::DOUBLE)"
_B = f"(6378137.0::DOUBLE * (1 - {_F}))"
_AB = f"""1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS a_, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS b_"""
_U2 = f"cos2 * (6378137.0::DOUBLE ** 2 - {_B} ** 2) / {_B} ** 2 AS u"
_BEND = "b_ * sin(s) * (mid + b_ / 4 * (cos(s) * (2 * mid * mid - 1) - b_ / 6 * mid * (4 * sin(s) ** 2 - 3) * (4 * mid * mid - 3)))"


def _forward(source: str, keep: str, name: str, turns: int = 8) -> str:
    """CTEs that put x2, y2 beside source(keep, lon, lat, az, d)."""
    out = f"""{name}_0 AS MATERIALIZED (SELECT *, atan((1 - {_F}) * tan(radians(lat))) AS u1, radians(az) AS a FROM {source}),
{name}_1 AS MATERIALIZED (SELECT *, cos(u1) * sin(a) AS slant, 1 - (cos(u1) * sin(a)) ** 2 AS cos2, atan2(tan(u1), cos(a)) AS first FROM {name}_0),
{name}_2 AS MATERIALIZED (SELECT *, {_AB} FROM (SELECT *, {_U2} FROM {name}_1)), {name}_s0 AS MATERIALIZED (SELECT *, d / ({_B} * a_) AS even, d / ({_B} * a_) AS s FROM {name}_2)"""
    for k in range(turns):
        out += f", {name}_s{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (s, mid), even + {_BEND} AS s FROM (SELECT *, cos(2 * first + s) AS mid FROM {name}_s{k}))"
    return out + f""", {name}_e AS MATERIALIZED (SELECT *, cos(2 * first + s) AS mid, sin(u1) * sin(s) - cos(u1) * cos(s) * cos(a) AS down, {_F} / 16 * cos2 * (4 + {_F} * (4 - 3 * cos2)) AS c FROM {name}_s{turns}),
{name} AS MATERIALIZED (SELECT {keep}, degrees(atan2(sin(u1) * cos(s) + cos(u1) * sin(s) * cos(a), (1 - {_F}) * sqrt(slant ** 2 + down ** 2))) AS y2,
  lon + degrees(atan2(sin(s) * sin(a), cos(u1) * cos(s) - sin(u1) * sin(s) * cos(a)) - (1 - c) * {_F} * slant * (s + c * sin(s) * (mid + c * cos(s) * (2 * mid * mid - 1)))) AS x2 FROM {name}_e)"""


def _inverse(source: str, keep: str, name: str, turns: int = 12) -> str:
    """CTEs that put distance, bearing beside source(keep, lon, lat, x2, y2)."""
    out = f"{name}_0 AS MATERIALIZED (SELECT *, atan((1 - {_F}) * tan(radians(lat))) AS p, atan((1 - {_F}) * tan(radians(y2))) AS q, radians(x2 - lon) AS l, radians(x2 - lon) AS lam FROM {source})"
    parts = f"""(SELECT *, CASE WHEN cos2 > 1e-15 THEN cs - 2 * sin(p) * sin(q) / cos2 ELSE 0 END AS mid FROM (SELECT *, 1 - slant ** 2 AS cos2, atan2(sn, cs) AS s FROM (
  SELECT *, CASE WHEN sn > 0 THEN cos(p) * cos(q) * sin(lam) / sn ELSE 0 END AS slant FROM (SELECT *, sqrt((cos(q) * sin(lam)) ** 2 + (cos(p) * sin(q) - sin(p) * cos(q) * cos(lam)) ** 2) AS sn, sin(p) * sin(q) + cos(p) * cos(q) * cos(lam) AS cs FROM {{0}}))))"""
    for k in range(turns):
        out += f""", {name}_{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (lam, sn, cs, slant, cos2, s, mid, c), l + (1 - c) * {_F} * slant * (s + c * sn * (mid + c * cs * (2 * mid * mid - 1))) AS lam
  FROM (SELECT *, {_F} / 16 * cos2 * (4 + {_F} * (4 - 3 * cos2)) AS c FROM {parts.format(f'{name}_{k}')}))"""
    return out + f""", {name} AS MATERIALIZED (SELECT {keep}, {_B} * a_ * (s - {_BEND}) AS distance, (degrees(atan2(cos(q) * sin(lam), cos(p) * sin(q) - sin(p) * cos(q) * cos(lam))) + 360) % 360 AS bearing
  FROM (SELECT *, {_AB} FROM (SELECT *, {_U2} FROM {parts.format(f'{name}_{turns}')})))"""


_PAIRS = f"WITH {B.SITES_SQL}, pairs AS (SELECT id, lon, lat, lon + (id % 91 - 45) * 0.9 AS x2, lat - (id % 83) * 1.1 AS y2 FROM sites)"


@query("geodesic_inverse", f"{_PAIRS}, {_inverse('pairs', 'id', 'g')} SELECT id, round(distance, 4) AS distance, CASE WHEN distance > 1 THEN round(bearing, 7) END AS bearing FROM g")
def geodesic_inverse(spark, sf_dir) -> DataFrame:
    pairs = B.sites(spark, sf_dir).selectExpr("id", "lon", "lat", "lon + (id % 91 - 45) * 0.9D as x2", "lat - (id % 83) * 1.1D as y2")
    found = pairs.withColumn("g", geodesics.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2")))
    return found.select("id", F.round("g.distance", 4).alias("distance"), F.when(F.col("g.distance") > 1, F.round("g.bearing", 7)).alias("bearing"))


_SHOTS = f"WITH {B.SITES_SQL}, shots AS (SELECT id, lon, lat, (id * 37 % 3600) / 10.0::DOUBLE AS az, (id % 97) * 81234.5::DOUBLE AS d FROM sites)"


@query("geodesic_forward", f"{_SHOTS}, {_forward('shots', 'id', 'g')} SELECT id, round((x2 + 540) % 360 - 180, 9) + 0.0 AS lon, round(y2, 9) + 0.0 AS lat FROM g")
def geodesic_forward(spark, sf_dir) -> DataFrame:
    shots = B.sites(spark, sf_dir).selectExpr("id", "lon", "lat", "(id * 37 % 3600) / 10.0D as az", "(id % 97) * 81234.5D as d")
    found = shots.withColumn("g", geodesics.geodesic_forward(F.col("lon"), F.col("lat"), F.col("az"), F.col("d")))
    return found.select("id", (F.round("g.lon", 9) + 0.0).alias("lon"), (F.round("g.lat", 9) + 0.0).alias("lat"))


#: Each leg in a step of its own; an order has under twenty line items.
_WALK = f"""WITH {B.LEGS_SQL}, w0 AS (SELECT DISTINCT t, -100.0 + t % 40 AS lon, 30.0 + t % 17 AS lat FROM legs)"""
for _k in range(1, 21):
    _WALK += f", l{_k} AS MATERIALIZED (SELECT w.t, w.lon, w.lat, degrees(l.az) AS az, l.d * 100.0::DOUBLE AS d FROM w{_k - 1} w JOIN legs l ON l.t = w.t AND l.seq = {_k}), {_forward(f'l{_k}', 't', f'f{_k}')}, w{_k} AS MATERIALIZED (SELECT t, x2 AS lon, y2 AS lat FROM f{_k})"
_WALK += ", walked AS (" + " UNION ALL ".join(f"SELECT t, {k} AS seq, lon, lat FROM w{k}" for k in range(1, 21)) + ")"


def _walked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    legs = B.legs(spark, sf_dir).select("t", "seq", F.degrees("az").alias("bearing"), (F.col("d") * 100).cast("double").alias("d"))
    starts = legs.select("t", (-100.0 + F.col("t") % 40).alias("lon"), (30.0 + F.col("t") % 17).alias("lat")).distinct()
    return geodetic.geodesic_traverse(legs, starts), starts


@query("geodesic_traverse", f"{_WALK} SELECT t, seq, round(lon, 8) AS lon, round(lat, 8) AS lat FROM walked")
def geodesic_traverse(spark, sf_dir) -> DataFrame:
    points, _ = _walked(spark, sf_dir)
    return points.select("t", "seq", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(
    "geodesic_closure",
    f"""{_WALK}, e AS (SELECT w.t, w0.lon AS x2, w0.lat AS y2, arg_max(w.lon, seq) AS lon, arg_max(w.lat, seq) AS lat FROM walked w JOIN w0 ON w0.t = w.t GROUP BY ALL), {_inverse('e', 't', 'g')}, n AS (SELECT t, count(*) AS n, sum(d * 100.0::DOUBLE) AS perimeter FROM legs GROUP BY t)
SELECT t, n, round(perimeter, 4) AS perimeter, round(distance, 3) AS closure FROM g JOIN n USING (t)""",
)
def geodesic_closure(spark, sf_dir) -> DataFrame:
    points, starts = _walked(spark, sf_dir)
    return geodetic.geodesic_closure(points, starts).select("t", "n", F.round("perimeter", 4).alias("perimeter"), F.round("closure", 3).alias("closure"))

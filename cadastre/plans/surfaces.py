"""Queries of surfaces over the point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.operators import clouds, surfaces
from cadastre.plans import bindings as B
from cadastre.plans.land import _DEM
from cadastre.plans.registry import query

_C = "WITH " + B.CLOUD_SQL


def _opening(source: str, size: int, name: str) -> str:
    """CTEs that open the grid ``source``(cloud, cx, cy, z, ..): least, then greatest within ``size`` cells, rows first."""
    w = lambda line, at: f"(PARTITION BY cloud, {line} ORDER BY {at} RANGE BETWEEN {size} PRECEDING AND {size} FOLLOWING)"
    steps, last = [], source
    for i, (f, column, line, at) in enumerate((("min", "z", "cy", "cx"), ("min", "m0", "cx", "cy"), ("max", "m1", "cy", "cx"), ("max", "m2", "cx", "cy"))):
        steps.append(f"{name}_{i} AS (SELECT *, {f}({column}) OVER {w(line, at)} AS m{i} FROM {last})")
        last = f"{name}_{i}"
    return ", ".join(steps)


_GRID = f"{_C}, pts AS (SELECT cloud, id, x, y, min(z) AS z FROM points GROUP BY ALL), g0 AS (SELECT cloud, floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, min(z) AS z, min(z) AS low, false AS obj FROM pts GROUP BY ALL)"
_SMRF = _GRID + "".join(f", {_opening(f'g{k - 1}', k, f's{k}')}, g{k} AS (SELECT cloud, cx, cy, m3 AS z, low, obj OR z - m3 > {4.0 * k * 2} AS obj FROM s{k}_3)" for k in range(1, 5))
_PMF = _GRID + "".join(f", {_opening(f'g{k}', size, f's{k}')}, g{k + 1} AS (SELECT cloud, cx, cy, CASE WHEN z - m3 > {threshold} THEN m3 ELSE z END AS z FROM s{k}_3)" for k, (size, threshold) in enumerate(((1, 1.5), (2, 5.5), (4, 9.5))))


def _points(spark, sf_dir) -> DataFrame:
    return B.points(spark, sf_dir).groupBy("cloud", "id", "x", "y").agg(F.min("z").alias("z"))


@query("classify_ground_smrf", f"{_SMRF} SELECT p.cloud, count(*) AS n, count(*) FILTER (p.z - CASE WHEN obj THEN g.z ELSE low END <= 3.0) AS ground FROM pts p JOIN g4 g ON g.cloud = p.cloud AND g.cx = floor(p.x / 2) AND g.cy = floor(p.y / 2) GROUP BY p.cloud")
def classify_ground_smrf(spark, sf_dir) -> DataFrame:
    judged = surfaces.classify_ground_smrf(_points(spark, sf_dir), 2.0, 4.0, 3.0, 16.0)
    return judged.groupBy("cloud").agg(F.count("*").alias("n"), F.count(F.when(F.col("ground"), 1)).alias("ground"))


@query("classify_ground_pmf", f"{_PMF} SELECT p.cloud, count(*) AS n, count(*) FILTER (p.z - g.z <= 1.5) AS ground FROM pts p JOIN g3 g ON g.cloud = p.cloud AND g.cx = floor(p.x / 2) AND g.cy = floor(p.y / 2) GROUP BY p.cloud")
def classify_ground_pmf(spark, sf_dir) -> DataFrame:
    judged = surfaces.classify_ground_pmf(_points(spark, sf_dir), 2.0, 2.0, 1.5, 20.0, 4)
    return judged.groupBy("cloud").agg(F.count("*").alias("n"), F.count(F.when(F.col("ground"), 1)).alias("ground"))


#: The raster's triangles with corners.
_TRI = f"""{_DEM}, q AS (SELECT a.cloud, a.cx, a.cy, (a.cx + 0.5) * 10 AS x, (a.cy + 0.5) * 10 AS y, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM dem a JOIN dem b ON b.cloud = a.cloud AND b.cx = a.cx + 1 AND b.cy = a.cy JOIN dem c ON c.cloud = a.cloud AND c.cx = a.cx AND c.cy = a.cy + 1
 JOIN dem d ON d.cloud = a.cloud AND d.cx = a.cx + 1 AND d.cy = a.cy + 1),
tri AS (SELECT cloud, cx, cy, 0 AS half, x AS ax, y AS ay, za AS az, x + 10 AS bx, y AS by_, zb AS bz, x + 10 AS cx_, y + 10 AS cy_, zd AS cz FROM q UNION ALL SELECT cloud, cx, cy, 1, x, y, za, x + 10, y + 10, zd, x, y + 10, zc FROM q)"""


def _triangles(spark, sf_dir) -> DataFrame:
    return surfaces.raster_triangles(clouds.grid_tin(clouds.dem_idw(B.points(spark, sf_dir), 10.0)), 10.0)


@query(
    "tin_interpolate",
    f"""{_TRI}, s AS (SELECT DISTINCT cloud, id, x + 0.013::DOUBLE AS x, y + 0.0017::DOUBLE AS y FROM points), k AS (SELECT s.*, floor((x - 5) / 10)::BIGINT AS cx, floor((y - 5) / 10)::BIGINT AS cy FROM s),
f AS (SELECT k.*, (x - 5) / 10 - cx AS u, (y - 5) / 10 - cy AS v FROM k) SELECT f.cloud, f.id, round(CASE WHEN u >= v THEN za + u * (zb - za) + v * (zd - zb) ELSE za + v * (zc - za) + u * (zd - zc) END, 4) AS z FROM f LEFT JOIN q USING (cloud, cx, cy)""",
)
def tin_interpolate(spark, sf_dir) -> DataFrame:
    points = B.points(spark, sf_dir).select("cloud", "id", (F.col("x") + 0.013).alias("x"), (F.col("y") + 0.0017).alias("y")).distinct()
    return surfaces.tin_interpolate(_triangles(spark, sf_dir), points, 10.0).select("cloud", "id", F.round("z", 4).alias("z"))


_SEGMENTS = f"""{_TRI}, l AS (SELECT *, unnest(range(ceil(least(az, bz, cz) / 2)::BIGINT, floor(greatest(az, bz, cz) / 2)::BIGINT + 1)) * 2.0 AS elev FROM tri), n AS (SELECT *, (az > elev)::INT + (bz > elev)::INT + (cz > elev)::INT AS n FROM l),
odd AS (SELECT *, CASE WHEN (az > elev) = (n = 1) THEN 0 WHEN (bz > elev) = (n = 1) THEN 1 ELSE 2 END AS odd FROM n WHERE n IN (1, 2)),
v AS (SELECT *, [ax, bx, cx_] AS xs, [ay, by_, cy_] AS ys, [az, bz, cz] AS zs FROM odd), e AS (SELECT *, (elev - zs[1 + odd]) / (zs[1 + (odd + 1) % 3] - zs[1 + odd]) AS t, (elev - zs[1 + odd]) / (zs[1 + (odd + 2) % 3] - zs[1 + odd]) AS u FROM v),
seg AS (SELECT cloud, elev, cx || ' ' || cy || ' ' || half AS tri, xs[1 + odd] + t * (xs[1 + (odd + 1) % 3] - xs[1 + odd]) AS px, ys[1 + odd] + t * (ys[1 + (odd + 1) % 3] - ys[1 + odd]) AS py, xs[1 + odd] + u * (xs[1 + (odd + 2) % 3] - xs[1 + odd]) AS qx, ys[1 + odd] + u * (ys[1 + (odd + 2) % 3] - ys[1 + odd]) AS qy FROM e)"""


@query("contour_segments", f"{_SEGMENTS} SELECT cloud, elev::DOUBLE AS elev, tri, round(px, 3) AS px, round(py, 3) AS py, round(qx, 3) AS qx, round(qy, 3) AS qy FROM seg")
def contour_segments(spark, sf_dir) -> DataFrame:
    s = surfaces.contour_segments(_triangles(spark, sf_dir), 2.0)
    return s.select("cloud", "elev", "tri", *[F.round(F.col(f"{e}.{c}"), 3).alias(f"{e}{c}") for e in "pq" for c in "xy"])


@query("contour_index_flag", f"{_SEGMENTS} SELECT cloud, elev::DOUBLE AS elev, (elev / 2)::BIGINT % 5 = 0 AS index, count(*) AS n FROM seg GROUP BY ALL")
def contour_index_flag(spark, sf_dir) -> DataFrame:
    s = surfaces.contour_index_flag(surfaces.contour_segments(_triangles(spark, sf_dir), 2.0), 2.0)
    return s.groupBy("cloud", "elev", "index").count().withColumnRenamed("count", "n")


@query("contour_chains")
def contour_chains(spark, sf_dir) -> DataFrame:
    chains = surfaces.contour_chains(surfaces.contour_segments(_triangles(spark, sf_dir), 2.0))
    return chains.select("cloud", "elev", F.size("line").cast("long").alias("points"), (F.col("line")[0] == F.element_at("line", -1)).alias("closed"))


@query("tin_tiles")
def tin_tiles(spark, sf_dir) -> DataFrame:
    thin = clouds.voxel_thin(B.points(spark, sf_dir), 4.0)
    return surfaces.tin_tiles(thin, 25.0, 10.0).select("cloud", "tri", *[F.round(F.col(f"{v}.z"), 6).alias(f"z{v}") for v in "abc"])


@query("surface_pipeline")
def surface_pipeline(spark, sf_dir) -> DataFrame:
    _, contours, _ = surfaces.surface_pipeline(B.points(spark, sf_dir), 5.0, 25.0, 15.0, 5.0, slope=4.0, threshold=20.0)
    return contours.groupBy("cloud", "elev").agg(F.count("*").alias("chains"), F.sum(F.size("line")).alias("points"))

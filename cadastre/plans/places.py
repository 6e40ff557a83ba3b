"""Queries of places, catalogues and exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import geodesy
from cadastre.operators import clouds, places
from cadastre.plans import bindings as B
from cadastre.plans.land import _HAV
from cadastre.plans.registry import query
from cadastre.sources import tables
from cadastre.sources.tables import load

_S = "WITH " + B.SITES_SQL


@query(
    "lonlat_ring_metrics",
    f"{_S}, v AS (SELECT id, seq, lon + CASE WHEN seq IN (1, 2) THEN 0.01 ELSE 0 END AS lon, lat + CASE WHEN seq IN (2, 3) THEN 0.02 ELSE 0 END AS lat FROM sites, (VALUES (0), (1), (2), (3), (4)) s(seq)), e AS (SELECT p.id, {_HAV.format(a='p', b='q')} AS d, radians(q.lon - p.lon) * (2 + sin(radians(p.lat)) + sin(radians(q.lat))) AS x FROM v p JOIN v q ON q.id = p.id AND q.seq = p.seq + 1) SELECT id, round(abs(sum(x)) * 6378137.0 * 6378137.0 / 2, 1) AS area, round(sum(d), 3) AS perimeter FROM e GROUP BY id",
)
def lonlat_ring_metrics(spark, sf_dir) -> DataFrame:
    ring = F.expr("transform(array(0, 1, 2, 3, 4), i -> struct(lon + if(i in (1, 2), 0.01D, 0D) as x, lat + if(i in (2, 3), 0.02D, 0D) as y))")
    return B.sites(spark, sf_dir).select("id", F.round(geodesy.lonlat_area(ring), 1).alias("area"), F.round(geodesy.lonlat_perimeter(ring), 3).alias("perimeter"))


@query("arc_densify", f"WITH {B.LEGS_SQL}, p AS (SELECT t, seq, i, l_partkey + d * cos(az + CASE WHEN 1.0 < az THEN 1.0 - az + 2 * pi() ELSE 1.0 - az END * i / 48) AS x FROM legs, (SELECT unnest(range(49)) AS i)) SELECT t, seq, 49::BIGINT AS n, round(sum(x * (i + 1)) + 1e-9, 4) AS x FROM p GROUP BY t, seq")
def arc_densify(spark, sf_dir) -> DataFrame:
    points = geodesy.arc_points(F.col("l_partkey"), F.lit(0.0), F.col("d"), F.col("az"), F.lit(1.0))
    rows = B.legs(spark, sf_dir).select("t", "seq", points.alias("p"))
    return rows.select("t", "seq", F.size("p").cast("long").alias("n"), F.round(F.expr("aggregate(transform(p, (q, i) -> q.x * (i + 1)), 0D, (s, v) -> s + v)") + 1e-9, 4).alias("x"))


#: The series to the third order, term by term.
_UTM = """c AS (SELECT (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n),
k AS (SELECT id, lat, floor((lon + 180) / 6)::BIGINT + 1 AS zone, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS w, 2 * sqrt(n) / (1 + n) AS e, sin(radians(lat)) AS s, n, 0.9996 * 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a,
  [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240] AS al FROM sites, c),
t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM k), x AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta FROM t)"""


@query(
    "utm_zones",
    f"""{_S}, {_UTM} SELECT id, zone, round(500000 + a * (eta + al[1] * cos(2 * xi) * sinh(2 * eta) + al[2] * cos(4 * xi) * sinh(4 * eta) + al[3] * cos(6 * xi) * sinh(6 * eta)), 3) AS east,
  round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + a * (xi + al[1] * sin(2 * xi) * cosh(2 * eta) + al[2] * sin(4 * xi) * cosh(4 * eta) + al[3] * sin(6 * xi) * cosh(6 * eta)), 3) AS north FROM x""",
)
def utm_zones(spark, sf_dir) -> DataFrame:
    zone, east, north = geodesy.utm(F.col("lon"), F.col("lat"))
    return B.sites(spark, sf_dir).select("id", zone.cast("long").alias("zone"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(
    "geoid_reduce",
    f"{_S}, k AS (SELECT *, lon / 5 - floor(lon / 5) AS u, lat / 5 - floor(lat / 5) AS v, floor(lon / 5)::BIGINT AS gx, floor(lat / 5)::BIGINT AS gy FROM sites), n AS (SELECT id, h, CASE WHEN gx < 0 AND gx + 1 <= 0 THEN (1 - u) * (1 - v) * (gx * 2 - gy) + u * (1 - v) * (gx * 2 + 2 - gy) + (1 - u) * v * (gx * 2 - gy - 1) + u * v * (gx * 2 + 1 - gy) END AS n FROM k) SELECT id, round(n, 6) + 0.0 AS n, round(h - n, 6) + 0.0 AS height FROM n",
)
def geoid_reduce(spark, sf_dir) -> DataFrame:
    grid = spark.range(-40, 1).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("gy")).select("gx", "gy", (F.col("gx") * 2.0 - F.col("gy")).alias("n"))
    out = places.geoid_reduce(B.sites(spark, sf_dir), grid, 5.0)
    return out.select("id", (F.round("n", 6) + 0.0).alias("n"), (F.round("height", 6) + 0.0).alias("height"))


@query("sun_windows")
def sun_windows(spark, sf_dir) -> DataFrame:
    sites = B.sites(spark, sf_dir).selectExpr("id", "lon", "lat", "timestamp'2026-06-21 00:00:00 UTC' as since", "timestamp'2026-06-22 00:00:00 UTC' as until")
    return places.sun_windows(sites, 30, 30.0, 60.0).select("id", "begins", "ends", "samples")


@query(
    "aoi_edge_points",
    f"WITH {B.PARCELS_SQL}, p AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, k, 2 * (x1 - x0 + y1 - y0) * k / 10 AS o FROM parcels, range(10) r(k)) SELECT id, k, round(CASE WHEN o < w THEN x0 + o WHEN o < w + h THEN x1 WHEN o < 2 * w + h THEN x1 - (o - w - h) ELSE x0 END, 4) AS x, round(CASE WHEN o < w THEN y0 WHEN o < w + h THEN y0 + o - w WHEN o < 2 * w + h THEN y1 ELSE y1 - (o - 2 * w - h) END, 4) AS y, CASE WHEN k < 4 THEN 'corner' ELSE 'edge_mid' END AS role FROM p",
)
def aoi_edge_points(spark, sf_dir) -> DataFrame:
    return places.aoi_edge_points(B.parcels(spark, sf_dir), 10).select("id", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "role")


@query("shot_sequence", "SELECT user_id AS file, event_id AS line_no, 'S' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR, 4, '0') AS shot_id FROM events")
def shot_sequence(spark, sf_dir) -> DataFrame:
    return places.shot_sequence(load(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no")))


@query("order_features", "WITH f AS (SELECT user_id AS file, event_type AS code, event_id % 2 AS number, min(event_id) AS first FROM events GROUP BY ALL) SELECT file, code, number, row_number() OVER (PARTITION BY file ORDER BY first, code, number) AS place FROM f")
def order_features(spark, sf_dir) -> DataFrame:
    features = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("code"), (F.col("event_id") % 2).alias("number")).agg(F.collect_list("event_id").alias("points"))
    return places.order_features(features).select("file", "code", "number", "place")


@query("survey_rollup", "SELECT n.n_nationkey AS project, n_name AS name, count(DISTINCT c_custkey) AS surveys, count(o_orderkey) AS parcels, round(coalesce(sum(o_totalprice), 0), 2)::DOUBLE AS area FROM nation n LEFT JOIN customer c ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def survey_rollup(spark, sf_dir) -> DataFrame:
    rows = lambda table, *columns: load(spark, sf_dir, table).selectExpr(*columns)
    out = places.survey_rollup(rows("nation", "n_nationkey as project", "n_name as name"), rows("customer", "c_custkey as survey", "c_nationkey as project"), rows("orders", "o_orderkey as parcel", "o_custkey as survey", "o_totalprice as area"))
    return out.withColumn("area", F.round("area", 2))


@query("register_clouds", f"WITH {B.CLOUD_SQL} SELECT cloud, count(*) AS n, min(z) AS min_z, max(x) AS max_x FROM points WHERE cloud <> 'A' GROUP BY cloud")
def register_clouds(spark, sf_dir) -> DataFrame:
    return places.register_clouds(B.points(spark, sf_dir), spark.createDataFrame([("A",)], "cloud string")).select("cloud", "n", "min_z", "max_x")


@query("curve_table_csv", """WITH c AS (SELECT p_partkey AS label, p_partkey % 97 + 10.5::DOUBLE AS r, radians(p_partkey % 90 + 0.5::DOUBLE) AS a FROM part)
SELECT label, label || ',' || printf('%.4f', r) || ',' || (label % 90) || '°30''00.00"' || ',' || printf('%.4f', r * a) || ',' || printf('%.4f', 2 * r * sin(a / 2)) || ',' || printf('%.4f', r * tan(a / 2)) AS line FROM c""")
def curve_table_csv(spark, sf_dir) -> DataFrame:
    curves = load(spark, sf_dir, "part").selectExpr("p_partkey as label", "p_partkey % 97 + 10.5D as radius", "radians(p_partkey % 90 + 0.5D) as delta")
    half = F.col("delta") / 2
    curves = curves.withColumns({"arc": F.col("radius") * F.col("delta"), "chord": 2 * F.col("radius") * F.sin(half), "tangent": F.col("radius") * F.tan(half)})
    return places.curve_table_csv(curves).select("label", "line")


@query("verify_inputs", "SELECT o_custkey AS root, o_orderkey AS hash, CASE WHEN o_orderkey % 10 = 1 THEN 'added' ELSE 'missing' END AS problem FROM orders WHERE o_orderkey % 10 IN (1, 2)")
def verify_inputs(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "orders").selectExpr("o_custkey as root", "o_orderkey as hash")
    return places.verify_inputs(rows.where("hash % 10 != 2"), rows.where("hash % 10 != 1"))


@query("scan_geojson", f"WITH {B.PARCELS_SQL} SELECT id AS file, 'Parcel 2' AS name, 32614::INTEGER AS epsg, x0, y1, round((x1 - x0) * (y1 - y0), 3) AS area FROM parcels")
def scan_geojson(spark, sf_dir) -> DataFrame:
    from cadastre.functions import rings

    point = lambda i: f"'[', ring[{i}].x, ',', ring[{i}].y, ']'"
    polygon = f"concat('[[', {point(0)}, ',', {point(3)}, ',', {point(2)}, ',', {point(1)}, ']]')"
    text = f"""concat('{{"type":"FeatureCollection","crs":{{"properties":{{"name":"EPSG:32614"}}}},"features":[{{"geometry":{{"type":"Point","coordinates":null}}}},{{"properties":{{"a":"b"}},"geometry":{{"type":"Polygon","coordinates":', {polygon}, '}}}}]}}')"""
    found = places.scan_geojson(B.parcels(spark, sf_dir).selectExpr("id as file", f"{text} as text"))
    x0, _, _, y1 = rings.bounds(F.col("ring"))
    return found.select("file", "name", "epsg", x0.alias("x0"), y1.alias("y1"), F.round(rings.signed_area(F.col("ring")), 3).alias("area"))


@query("file_fingerprints")
def file_fingerprints(spark, sf_dir) -> DataFrame:
    """The given table files; their bytes are no table that SQL has, so pytest holds them against hashlib."""
    return tables.file_fingerprints(spark, sf_dir, "*.parquet").select(F.substring_index("path", "/", -1).alias("name"), "size", "hash")

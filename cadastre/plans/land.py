"""Queries of parcels, points, title, evidence, geodesy, edit logs and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import geodesy, rings
from cadastre.operators import clouds, corpus, editlog, spatial, title
from cadastre.operators import evidence as E
from cadastre.plans import bindings as B
from cadastre.plans.registry import query
from cadastre.plans.traverse import _a, _norm, a, r
from cadastre.sources.tables import load

_P, _L, _C, _E, _O, _S = ("WITH " + x for x in (B.PARCELS_SQL, B.LINKS_SQL, B.CLOUD_SQL, B.EVIDENCE_SQL, B.OPS_SQL, B.SITES_SQL))


# Rings and spatial joins.


@query(
    "polygon_metrics",
    f"{_P} SELECT id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0, y0, x1, y1, true AS ccw, 4::BIGINT AS vertices FROM parcels",
)
def polygon_metrics(spark, sf_dir) -> DataFrame:
    ring = F.col("ring")
    cx, cy = rings.centroid(ring)
    x0, y0, x1, y1 = rings.bounds(ring)
    area = rings.signed_area(ring)
    return B.parcels(spark, sf_dir).select("id", area.alias("area"), rings.perimeter(ring).alias("perimeter"), cx.alias("cx"), cy.alias("cy"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (area > 0).alias("ccw"), (F.size(ring) - 1).cast("long").alias("vertices"))


@query("orient_rings", f"{_P} SELECT id, -(x1 - x0) * (y1 - y0) AS given, (x1 - x0) * (y1 - y0) AS outer_area, -(x1 - x0) * (y1 - y0) AS hole_area, true AS valid FROM parcels")
def orient_rings(spark, sf_dir) -> DataFrame:
    opened = F.reverse(F.slice("ring", 1, 4))  # clockwise and open
    ring = rings.closed(opened)
    rows = B.parcels(spark, sf_dir).withColumn("ring", ring)
    given = F.col("ring")
    return rows.select("id", rings.signed_area(given).alias("given"), rings.signed_area(rings.oriented(given)).alias("outer_area"), rings.signed_area(rings.oriented(given, False)).alias("hole_area"), rings.valid(given).alias("valid"))


@query(
    "to_wkt",
    f"{_P} SELECT id, 'POLYGON((' || concat_ws(', ', x0 || ' ' || y0, x1 || ' ' || y0, x1 || ' ' || y1, x0 || ' ' || y1, x0 || ' ' || y0) || '))' AS wkt FROM parcels",
)
def to_wkt(spark, sf_dir) -> DataFrame:
    return B.parcels(spark, sf_dir).select("id", rings.wkt(F.col("ring")).alias("wkt"))


@query(
    "bbox_predicates",
    f"{_P} SELECT id, x0 <= 2500 AND x1 >= 2500 AND y0 <= 2500 AND y1 >= 2500 AS holds_centre, x0 <= 1000 AND y0 <= 1000 AS meets_corner, (x1 - x0 + 10) * (y1 - y0 + 10) AS expanded FROM parcels",
)
def bbox_predicates(spark, sf_dir) -> DataFrame:
    rows = spatial.with_box(B.parcels(spark, sf_dir))
    holds = F.lit(2500.0).between(F.col("x0"), F.col("x1")) & F.lit(2500.0).between(F.col("y0"), F.col("y1"))
    return rows.select("id", holds.alias("holds_centre"), ((F.col("x0") <= 1000) & (F.col("y0") <= 1000)).alias("meets_corner"), F.expr("(x1 - x0 + 10) * (y1 - y0 + 10)").alias("expanded"))


@query(
    "parcel_overlaps",
    f"""{_P} SELECT a.id AS a, b.id AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 3) AS area
FROM parcels a JOIN parcels b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def parcel_overlaps(spark, sf_dir) -> DataFrame:
    return spatial.parcel_overlaps(B.parcels(spark, sf_dir), 64.0, 1e-6).select("a", "b", F.round("area", 3).alias("area"))


_DENSE = "WITH " + B.DENSE_SQL


@query(
    "parcel_overlaps_dense",
    f"""{_DENSE} SELECT a.id AS a, b.id AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 3) AS area
FROM parcels a JOIN parcels b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def parcel_overlaps_dense(spark, sf_dir) -> DataFrame:
    return spatial.parcel_overlaps(B.parcels(spark, sf_dir, dense=True), 64.0, 1e-6).select("a", "b", F.round("area", 3).alias("area"))


#: L-shapes: each parcel without its upper right quarter.  What two have in common is by inclusion and exclusion of boxes.
_L_SHAPES = f"""{_P}, l AS (SELECT *, (x0 + x1) / 2 AS xm, (y0 + y1) / 2 AS ym FROM parcels),
pairs AS (SELECT a.id AS a, b.id AS b, {{}} AS area FROM l a JOIN l b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT a, b, round(area, 3) AS area FROM pairs WHERE area > 1e-6"""


def _boxes_meet(p: str, q: str) -> str:
    """Area that two boxes share, each the whole one (x0, y0) or the quarter from (xm, ym)."""
    low = lambda axis: f"greatest(a.{axis}{p}, b.{axis}{q})"
    return f"greatest(least(a.x1, b.x1) - {low('x')}, 0) * greatest(least(a.y1, b.y1) - {low('y')}, 0)"


@query("parcel_overlaps_concave", _L_SHAPES.format(f"{_boxes_meet('0', '0')} - {_boxes_meet('m', '0')} - {_boxes_meet('0', 'm')} + {_boxes_meet('m', 'm')}"))
def parcel_overlaps_concave(spark, sf_dir) -> DataFrame:
    """Every second ring runs clockwise."""
    point = lambda x, y: f"struct({x} as x, {y} as y)"
    xm, ym = "(x0 + x1) / 2", "(y0 + y1) / 2"
    corners = ", ".join(point(*c) for c in (("x0", "y0"), ("x1", "y0"), ("x1", ym), (xm, ym), (xm, "y1"), ("x0", "y1"), ("x0", "y0")))
    shapes = spatial.with_box(B.parcels(spark, sf_dir)).selectExpr("id", f"if(id % 2 = 0, array({corners}), reverse(array({corners}))) as ring")
    return spatial.parcel_overlaps(shapes, 64.0, 1e-6).select("a", "b", F.round("area", 3).alias("area"))


@query(
    "clip_polygons",
    f"{_P} SELECT id, round(greatest(least(x1, 2500) - greatest(x0, 0), 0) * greatest(least(y1, 2500) - greatest(y0, 0), 0), 3) AS area FROM parcels WHERE x0 < 2500 AND y0 < 2500",
)
def clip_polygons(spark, sf_dir) -> DataFrame:
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    window = F.array(*[corner(x, y) for x, y in ((0.0, 0.0), (2500.0, 0.0), (2500.0, 2500.0), (0.0, 2500.0), (0.0, 0.0))])
    rows = spatial.with_box(B.parcels(spark, sf_dir)).where("x0 < 2500 and y0 < 2500")
    return rows.select("id", F.round(F.abs(rings.signed_area(rings.clip(F.col("ring"), window))), 3).alias("area"))


_SHOTS = "shots AS (SELECT l_orderkey * 1000000 + l_partkey * 8 + l_linenumber AS id, (l_partkey * 13 + l_orderkey * 17) % side + 0.37::DOUBLE AS x, (l_suppkey * 29 + l_orderkey) % side + 0.71::DOUBLE AS y FROM lineitem, side)"


def shots(spark, sf_dir, dense: bool = False) -> DataFrame:
    k = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 8 + F.col("l_linenumber")
    x, y = (F.col("l_partkey") * 13 + F.col("l_orderkey") * 17) % F.col("side"), (F.col("l_suppkey") * 29 + F.col("l_orderkey")) % F.col("side")
    return load(spark, sf_dir, "lineitem").crossJoin(F.broadcast(B.plane(spark, sf_dir, dense))).select(k.alias("id"), (x + 0.37).alias("x"), (y + 0.71).alias("y"))


@query("points_in_parcels", f"{_P}, {_SHOTS} SELECT s.id AS point, p.id AS parcel FROM shots s JOIN parcels p ON s.x > p.x0 AND s.x < p.x1 AND s.y > p.y0 AND s.y < p.y1")
def points_in_parcels(spark, sf_dir) -> DataFrame:
    return spatial.points_in_parcels(shots(spark, sf_dir), B.parcels(spark, sf_dir), 40.0)


@query("points_in_parcels_dense", f"{_DENSE}, {_SHOTS} SELECT s.id AS point, p.id AS parcel FROM shots s JOIN parcels p ON s.x > p.x0 AND s.x < p.x1 AND s.y > p.y0 AND s.y < p.y1")
def points_in_parcels_dense(spark, sf_dir) -> DataFrame:
    return spatial.points_in_parcels(shots(spark, sf_dir, dense=True), B.parcels(spark, sf_dir, dense=True), 40.0)


_NODES = f"{_P}, {_SHOTS}, near AS (SELECT s.id, n.id AS node, round(sqrt((s.x - n.x0) ** 2 + (s.y - n.y0) ** 2), 9) AS dist FROM shots s JOIN parcels n ON abs(s.x - n.x0) <= 8 AND abs(s.y - n.y0) <= 8 WHERE sqrt((s.x - n.x0) ** 2 + (s.y - n.y0) ** 2) <= 8)"


def _nodes(spark, sf_dir) -> DataFrame:
    return spatial.with_box(B.parcels(spark, sf_dir)).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))


@query("snap_query", f"{_NODES} SELECT id, arg_min(node, (dist, node)) AS node, round(min(dist), 6) AS dist FROM near GROUP BY id")
def snap_query(spark, sf_dir) -> DataFrame:
    # Line items that repeat in full give one shot.
    return spatial.snap_query(shots(spark, sf_dir).dropDuplicates(["id"]), _nodes(spark, sf_dir), 8.0).select("id", "node", F.round("dist", 6).alias("dist"))


@query("duplicate_nodes", f"{_P} SELECT a.id AS a_id, b.id AS b_id, round(sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2), 6) AS dist FROM parcels a JOIN parcels b ON a.id < b.id AND (a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2 <= 25")
def duplicate_nodes(spark, sf_dir) -> DataFrame:
    return spatial.duplicate_nodes(_nodes(spark, sf_dir), 5.0).select("a_id", "b_id", F.round("dist", 6).alias("dist"))


# Title chains.


def links(spark, sf_dir) -> DataFrame:
    return title.grantor_grantee_links(B.deeds(spark, sf_dir))


_CHAIN = "PARTITION BY parcel ORDER BY recorded NULLS LAST, input_pos"
_N = lambda c: B.NAME_SQL.format(c)


@query("grantor_grantee_links", f"{_L} SELECT parcel, deed, grantor, grantee FROM links")
def grantor_grantee_links(spark, sf_dir) -> DataFrame:
    return links(spark, sf_dir).select("parcel", "deed", "grantor", "grantee")


@query("normalize_names", f"{_L} SELECT deed, {_N('grantor')} AS grantor, {_N('grantee')} AS grantee FROM links")
def normalize_names(spark, sf_dir) -> DataFrame:
    return links(spark, sf_dir).select("deed", title.normalized_name(F.col("grantor")).alias("grantor"), title.normalized_name(F.col("grantee")).alias("grantee"))


@query("order_chain", f"{_L} SELECT parcel, deed, row_number() OVER ({_CHAIN}) AS place FROM links")
def order_chain(spark, sf_dir) -> DataFrame:
    return title.ordered_chain(links(spark, sf_dir)).select("parcel", "deed", "place")


@query("title_gaps", f"{_L}, g AS (SELECT parcel, deed, recorded - lag(recorded) OVER ({_CHAIN}) AS gap_days FROM links) SELECT * FROM g WHERE gap_days > 90")
def title_gaps(spark, sf_dir) -> DataFrame:
    # The orders span a few years: the bound is lower than the operator's.
    return title.title_gaps(links(spark, sf_dir), 90).select("parcel", "deed", F.col("gap_days").cast("long").alias("gap_days"))


@query("duplicate_instruments", f"{_L}, u AS (SELECT parcel, deed, row_number() OVER (PARTITION BY parcel, instrument ORDER BY input_pos) AS use FROM links) SELECT * FROM u WHERE use > 1")
def duplicate_instruments(spark, sf_dir) -> DataFrame:
    return title.duplicate_instruments(links(spark, sf_dir)).select("parcel", "deed", "use")


_WILD = f"{_L}, n AS (SELECT parcel, deed, recorded, {_N('grantor')} AS f, {_N('grantee')} AS g, row_number() OVER ({_CHAIN}) AS place FROM links)"


@query("wild_deeds", f"{_WILD} SELECT parcel, deed, place FROM n WHERE place > 1 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.parcel = n.parcel AND m.place < n.place AND m.g = n.f)")
def wild_deeds(spark, sf_dir) -> DataFrame:
    return title.wild_deeds(links(spark, sf_dir)).select("parcel", "deed", "place")


@query("date_inversions", f"{_WILD}, q AS (SELECT parcel, g, min(recorded) AS since FROM n GROUP BY parcel, g) SELECT n.parcel, deed FROM n JOIN q ON q.parcel = n.parcel AND q.g = n.f WHERE n.recorded < q.since")
def date_inversions(spark, sf_dir) -> DataFrame:
    return title.date_inversions(links(spark, sf_dir)).select("parcel", "deed")


@query("forks", f"{_WILD} SELECT parcel, f AS grantor, count(DISTINCT g) AS grantees FROM n GROUP BY parcel, f HAVING count(DISTINCT g) > 1")
def forks(spark, sf_dir) -> DataFrame:
    return title.forks(links(spark, sf_dir))


@query("self_conveyances", f"{_WILD} SELECT parcel, deed FROM n WHERE f = g")
def self_conveyances(spark, sf_dir) -> DataFrame:
    return title.self_conveyances(links(spark, sf_dir)).select("parcel", "deed")


_DEFECTS = f"""{_WILD}, k AS (
  SELECT parcel, 'duplicate' AS kind FROM (SELECT parcel, row_number() OVER (PARTITION BY parcel, instrument ORDER BY input_pos) AS use FROM links) WHERE use > 1
  UNION ALL SELECT parcel, 'gap' FROM (SELECT parcel, recorded - lag(recorded) OVER ({_CHAIN}) AS g FROM links) WHERE g > 10950
  UNION ALL SELECT parcel, 'wild' FROM n WHERE place > 1 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.parcel = n.parcel AND m.place < n.place AND m.g = n.f)
  UNION ALL SELECT parcel, 'self' FROM n WHERE f = g
  UNION ALL SELECT parcel, 'fork' FROM (SELECT parcel, f FROM n GROUP BY parcel, f HAVING count(DISTINCT g) > 1)
  UNION ALL SELECT n.parcel, 'inversion' FROM n JOIN (SELECT parcel, g, min(recorded) AS since FROM n GROUP BY parcel, g) q ON q.parcel = n.parcel AND q.g = n.f WHERE n.recorded < q.since)
SELECT parcel, kind, count(*) AS defects FROM k GROUP BY CUBE (parcel, kind)"""


@query("chain_defect_summary", _DEFECTS)
def chain_defect_summary(spark, sf_dir) -> DataFrame:
    return title.chain_defect_summary(links(spark, sf_dir))


# Evidence.


def _sum(value: str) -> str:
    """A sum over the list p, added up in its order."""
    return f"list_reduce([{value} for q in p], lambda s, v: s + v)"


@query("evidence_weights", f"{_E} SELECT corner, kind, state, rule_weight, round(rule_weight / (greatest(sigma, 1e-6) ** 2), 4) AS w FROM weighted")
def evidence_weights(spark, sf_dir) -> DataFrame:
    return E.evidence_weights(B.evidence(spark, sf_dir), E.state_rules(spark)).select("corner", "kind", "state", "rule_weight", F.round("w", 4).alias("w"))


@query(
    "determine_boundary",
    f"""{_E}, w AS (SELECT corner, x, y, greatest(sigma, 1e-6) AS s, rule_weight / (greatest(sigma, 1e-6) * greatest(sigma, 1e-6)) AS w FROM weighted),
g AS (SELECT corner, max(s) AS top, list({{'x': x, 'y': y, 'w': w}} ORDER BY x, y, w, s) AS p FROM w GROUP BY corner),
m AS (SELECT corner, top, p, {_sum('q.w')} AS sw, {_sum('q.w * q.x')} / {_sum('q.w')} AS x0, {_sum('q.w * q.y')} / {_sum('q.w')} AS y0 FROM g),
d AS (SELECT corner, top, sw, [{{'x': q.x, 'y': q.y, 'w': q.w, 'r': sqrt((q.x - x0) * (q.x - x0) + (q.y - y0) * (q.y - y0))}} for q in p] AS p FROM m),
f AS (SELECT corner, p, sqrt({_sum('q.w * q.r * q.r')} / sw) AS rms, 3 * top AS far FROM d),
k AS (SELECT corner, p AS every, [q for q in p if q.r <= greatest(3 * CASE WHEN rms > 0 THEN rms ELSE 1e-6 END, far)] AS kept FROM f),
k2 AS (SELECT corner, len(every) AS n, CASE WHEN len(kept) = 0 THEN every ELSE kept END AS p FROM k),
s AS (SELECT corner, n, p, {_sum('q.w')} AS sw, {_sum('q.w * q.x')} / {_sum('q.w')} AS fx, {_sum('q.w * q.y')} / {_sum('q.w')} AS fy FROM k2)
SELECT corner, n, len(p) AS n_kept, round(fx + 1e-9, 6) AS x, round(fy + 1e-9, 6) AS y, round(sqrt({_sum('q.w * (q.x - fx) * (q.x - fx)')} / greatest(sw, 1e-12)) + 1e-9, 6) AS sigma_x FROM s""",
)
def determine_boundary(spark, sf_dir) -> DataFrame:
    out = E.determine_boundary(E.evidence_weights(B.evidence(spark, sf_dir), E.state_rules(spark)))
    return out.select("corner", "n", "n_kept", F.round(F.col("x") + 1e-9, 6).alias("x"), F.round(F.col("y") + 1e-9, 6).alias("y"), F.round(F.col("sigma_x") + 1e-9, 6).alias("sigma_x"))


# Point clouds.


@query("cloud_stats", f"{_C} SELECT cloud, classification, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY ROLLUP (cloud, classification) HAVING cloud IS NOT NULL")
def cloud_stats(spark, sf_dir) -> DataFrame:
    return clouds.cloud_stats(B.points(spark, sf_dir))


@query("cloud_filter_class", f"{_C} SELECT cloud, id, classification FROM points WHERE classification IN (2, 6)")
def cloud_filter_class(spark, sf_dir) -> DataFrame:
    return clouds.cloud_filter_class(B.points(spark, sf_dir), [2, 6]).select("cloud", "id", "classification")


@query("cloud_stride_sample", f"{_C}, d AS (SELECT DISTINCT ON (cloud, id) cloud, id FROM points), k AS (SELECT cloud, id, row_number() OVER (PARTITION BY cloud ORDER BY id) - 1 AS rank, count(*) OVER (PARTITION BY cloud) AS n FROM d) SELECT cloud, id FROM k WHERE rank % greatest(n // 500, 1) = 0")
def cloud_stride_sample(spark, sf_dir) -> DataFrame:
    return clouds.cloud_stride_sample(B.points(spark, sf_dir).dropDuplicates(["cloud", "id"]), 500).select("cloud", "id")


@query(
    "voxel_thin",
    f"""{_C}, v AS (SELECT *, floor(x / 5) AS vx, floor(y / 5) AS vy, floor(z / 5) AS vz FROM points), o AS (SELECT *, round((x - (vx + 0.5) * 5) ** 2 + (y - (vy + 0.5) * 5) ** 2 + (z - (vz + 0.5) * 5) ** 2, 9) AS off FROM v)
SELECT cloud, arg_min(id, (off, id)) AS id FROM o GROUP BY cloud, vx, vy, vz""",
)
def voxel_thin(spark, sf_dir) -> DataFrame:
    return clouds.voxel_thin(B.points(spark, sf_dir), 5.0).select("cloud", "id")


_DEM = f"""{_C}, o AS (SELECT cloud, floor(x / 10) + i AS cx, floor(y / 10) + j AS cy, x, y, z FROM points, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
w AS (SELECT *, 1 / greatest(sqrt((x - (cx + 0.5) * 10) ** 2 + (y - (cy + 0.5) * 10) ** 2), 1e-6) ** 2 AS w FROM o), dem AS (SELECT cloud, cx::BIGINT AS cx, cy::BIGINT AS cy, sum(z * w) / sum(w) AS z FROM w GROUP BY ALL)"""


@query("dem_idw", f"{_DEM} SELECT cloud, cx, cy, round(z, 5) AS z FROM dem")
def dem_idw(spark, sf_dir) -> DataFrame:
    return clouds.dem_idw(B.points(spark, sf_dir), 10.0).select("cloud", "cx", "cy", F.round("z", 5).alias("z"))


@query(
    "grid_tin",
    f"""{_DEM}, q AS (SELECT a.cloud, a.cx, a.cy, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM dem a JOIN dem b ON b.cloud = a.cloud AND b.cx = a.cx + 1 AND b.cy = a.cy JOIN dem c ON c.cloud = a.cloud AND c.cx = a.cx AND c.cy = a.cy + 1
 JOIN dem d ON d.cloud = a.cloud AND d.cx = a.cx + 1 AND d.cy = a.cy + 1)
SELECT cloud, cx, cy, 0 AS half, round(za + zb + zd, 4) AS z_sum FROM q UNION ALL SELECT cloud, cx, cy, 1, round(za + zd + zc, 4) FROM q""",
)
def grid_tin(spark, sf_dir) -> DataFrame:
    return clouds.grid_tin(clouds.dem_idw(B.points(spark, sf_dir), 10.0)).select("cloud", "cx", "cy", "half", F.round(F.expr("z1 + z2 + z3"), 4).alias("z_sum"))


@query(
    "residual_stats",
    f"{_C} SELECT cloud, count(*) AS n, round(sqrt(avg(z * z)), 5) AS rms, round(coalesce(stddev_samp(z), 0), 5) AS std, round(avg(z * z), 4) AS mse, round(avg(z) - 1.959964 * coalesce(stddev_samp(z), 0) / sqrt(count(*)), 5) AS lo, round(avg(z) + 1.959964 * coalesce(stddev_samp(z), 0) / sqrt(count(*)), 5) AS hi FROM points GROUP BY cloud",
)
def residual_stats(spark, sf_dir) -> DataFrame:
    s = clouds.residual_stats(B.points(spark, sf_dir), "z", "cloud")
    return s.select("cloud", "n", *[F.round(c, 4 if c == "mse" else 5).alias(c) for c in ("rms", "std", "mse", "lo", "hi")])


# Geodesy.

_HAV = "2 * 6378137.0 * asin(sqrt(least(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2, 1.0)))"
_BEAR = "atan2(sin(radians({b}.lon - {a}.lon)) * cos(radians({b}.lat)), cos(radians({a}.lat)) * sin(radians({b}.lat)) - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos(radians({b}.lon - {a}.lon)))"


def _site_pairs(spark, sf_dir) -> DataFrame:
    s = B.sites(spark, sf_dir)
    return s.join(s.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "id")


@query("great_circle", f"{_S} SELECT p.id, round({_HAV.format(a='p', b='q')}, 3) AS distance, {_a(_norm(_BEAR.format(a='p', b='q')))} AS bearing FROM sites p JOIN sites q ON q.id = p.id + 1")
def great_circle(spark, sf_dir) -> DataFrame:
    at = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    return _site_pairs(spark, sf_dir).select("id", F.round(geodesy.haversine(*at), 3).alias("distance"), a(geodesy.initial_bearing(*at)).alias("bearing"))


_REGION = "CASE WHEN lat BETWEEN 40 AND 75 AND lon BETWEEN -180 AND -130 THEN 'Alaska' WHEN lat BETWEEN 18 AND 23 AND lon BETWEEN -161 AND -154 THEN 'Hawaii' WHEN lon BETWEEN -130 AND -114 THEN 'Pacific' WHEN lon BETWEEN -100 AND -80 AND lat BETWEEN 24 AND 31 THEN 'Gulf' ELSE 'Atlantic' END"


@query("coastal_region", f"{_S} SELECT id, {_REGION} AS region FROM sites")
def coastal_region(spark, sf_dir) -> DataFrame:
    return B.sites(spark, sf_dir).select("id", geodesy.coastal_region(F.col("lon"), F.col("lat")).alias("region"))


_TIDE_ROWS = ", ".join(f"('{n}', {t['mllw']!r}::DOUBLE, {t['msl']!r}::DOUBLE, {t['mhhw']!r}::DOUBLE)" for n, t in geodesy.TIDES.items())


@query("tidal_heights", f"{_S}, g AS (SELECT *, {_REGION} AS region FROM sites) SELECT id, round(h - mllw, 6) + 0.0 AS mllw, round(h - msl, 6) + 0.0 AS msl, round(h - mhhw, 6) + 0.0 AS mhhw FROM g JOIN (VALUES {_TIDE_ROWS}) t(region, mllw, msl, mhhw) USING (region)")
def tidal_heights(spark, sf_dir) -> DataFrame:
    region = geodesy.coastal_region(F.col("lon"), F.col("lat"))
    return B.sites(spark, sf_dir).withColumn("region", region).select("id", *[r(geodesy.tidal_height(F.col("region"), d, F.col("h"))).alias(d) for d in ("mllw", "msl", "mhhw")])


def _mod(x: str, n: str) -> str:
    return f"(({x}) - floor(({x}) / {n}) * {n})"


_SUN = f"""{_S}, k AS (SELECT *, (epoch_us(TIMESTAMP '2026-06-21 00:00:00' + to_hours((id % 24)::INTEGER)) / 1e6 - 946728000.0) / 86400.0 AS dd FROM sites),
g AS (SELECT *, radians({_mod('357.529 + 0.98560028 * dd', '360.0')}) AS g, radians({_mod('280.459 + 0.98564736 * dd', '360.0')}) AS m, radians(23.439 - 0.00000036 * dd) AS e FROM k),
l AS (SELECT *, m + radians(1.915) * sin(g) + radians(0.020) * sin(2 * g) AS lam FROM g), q AS (SELECT *, atan2(cos(e) * sin(lam), cos(lam)) AS ra, asin(sin(e) * sin(lam)) AS de FROM l),
h AS (SELECT *, radians(({_mod('18.697374558 + 24.06570982441908 * dd', '24.0')} + lon / 15.0) * 15.0) - ra AS ha, radians(lat) AS phi FROM q)
SELECT id, round(degrees(asin(sin(phi) * sin(de) + cos(phi) * cos(de) * cos(ha))), 4) + 0.0 AS altitude, round({_mod('degrees(atan2(-sin(ha) * cos(de), cos(phi) * sin(de) - sin(phi) * cos(de) * cos(ha)))', '360.0')}, 4) + 0.0 AS azimuth FROM h"""


@query("sun_position", _SUN)
def sun_position(spark, sf_dir) -> DataFrame:
    ts = F.expr("timestamp'2026-06-21 00:00:00 UTC' + make_dt_interval(0, cast(id % 24 as int))")
    altitude, az = geodesy.sun_position(ts, F.col("lat"), F.col("lon"))
    return B.sites(spark, sf_dir).select("id", r(altitude, 4).alias("altitude"), r(az, 4).alias("azimuth"))


# Edit logs, provenance, corpora.


@query("lww_merge", f"{_O} SELECT doc, key, arg_max(value, (ts, actor)) AS value, count(*) AS writes FROM ops GROUP BY doc, key")
def lww_merge(spark, sf_dir) -> DataFrame:
    return editlog.lww_merge(B.ops(load(spark, sf_dir, "events")))


@query(
    "vertex_state",
    f"{_O}, p AS (SELECT doc, vertex, arg_max(x, (ts, actor)) AS x, arg_max(y, (ts, actor)) AS y FROM ops WHERE kind <> 'delete' GROUP BY doc, vertex) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.kind = 'delete' AND o.doc = p.doc AND o.vertex = p.vertex)",
)
def vertex_state(spark, sf_dir) -> DataFrame:
    return editlog.vertex_state(B.ops(load(spark, sf_dir, "events")))


_HASHES = f"{_O}, m AS (SELECT doc AS manifest, count(*) AS entries, sha256(string_agg(op_id::VARCHAR || ':' || kind, chr(10) ORDER BY op_id)) AS hash FROM ops GROUP BY doc)"


def _manifest(ops: DataFrame) -> DataFrame:
    return editlog.manifest_hashes(ops.select(F.col("doc").alias("manifest"), F.col("op_id").alias("pos"), F.concat_ws(":", "op_id", "kind").alias("entry")))


@query("manifest_hashes", f"{_HASHES} SELECT * FROM m")
def manifest_hashes(spark, sf_dir) -> DataFrame:
    return _manifest(B.ops(load(spark, sf_dir, "events")))


@query("tamper_report", f"{_O} SELECT DISTINCT doc AS manifest, CASE WHEN doc = 3 THEN 'missing' ELSE 'changed' END AS problem FROM ops WHERE doc = 3 OR (doc <> 3 AND op_id % 400 = 0)")
def tamper_report(spark, sf_dir) -> DataFrame:
    ops = B.ops(load(spark, sf_dir, "events"))
    changed = ops.where("doc != 3").withColumn("kind", F.when(F.col("op_id") % 400 == 0, "forged").otherwise(F.col("kind")))
    return editlog.tamper_report(_manifest(ops), _manifest(changed))


_HASHED = r"hashed AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents)"


@query("dedupe_corpus", f"WITH {_HASHED} SELECT hash, min(doc_id) AS doc_id, count(*) AS copies FROM hashed GROUP BY hash")
def dedupe_corpus(spark, sf_dir) -> DataFrame:
    return corpus.dedupe_corpus(load(spark, sf_dir, "documents"))


@query("corpus_stats", f"WITH {_HASHED}, c AS (SELECT hash, count(*) AS n FROM hashed GROUP BY hash) SELECT sum(n)::BIGINT AS total, count(*) AS kept, sum(n - 1)::BIGINT AS duplicates FROM c")
def corpus_stats(spark, sf_dir) -> DataFrame:
    return corpus.corpus_stats(load(spark, sf_dir, "documents"))


@query("write_splits", f"WITH {_HASHED}, s AS (SELECT doc_id, ('0x' || hash[1:8])::BIGINT % 100 AS b FROM hashed) SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM s")
def write_splits(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", corpus.split_of(corpus.text_hash(F.col("text"))).alias("split"))

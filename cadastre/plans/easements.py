"""Queries of easements: along traverses, and across the plane of parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.operators import easements as E
from cadastre.plans import bindings as B
from cadastre.plans.registry import query
from cadastre.plans.traverse import r
from cadastre.sources.tables import load

#: Centrelines along traverses of whole degrees, from the origin.
_LINES = f"""WITH {B.LEGS_SQL}, run AS (SELECT t, seq, sum(d * sin(az)) OVER w AS x, sum(d * cos(az)) OVER w AS y FROM legs WINDOW w AS (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING) UNION ALL SELECT DISTINCT t, 0, 0.0, 0.0 FROM legs),
d AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM run WINDOW w AS (PARTITION BY t ORDER BY seq)), n AS (SELECT *, -dy / sqrt(dx * dx + dy * dy) AS nx, dx / sqrt(dx * dx + dy * dy) AS ny FROM d),
b AS (SELECT *, lag(nx) OVER w AS px, lag(ny) OVER w AS py FROM n WINDOW w AS (PARTITION BY t ORDER BY seq)), s AS (SELECT *, px + nx AS sx, py + ny AS sy, sqrt((px + nx) ** 2 + (py + ny) ** 2) AS norm FROM b),
o AS (SELECT t, seq, x, y, 2.0 * CASE WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px WHEN norm < 1e-12 THEN px WHEN norm < 1 THEN sx / 2 ELSE 2 * sx / norm / norm END AS ox, 2.0 * CASE WHEN px IS NULL THEN ny WHEN nx IS NULL THEN py WHEN norm < 1e-12 THEN py WHEN norm < 1 THEN sy / 2 ELSE 2 * sy / norm / norm END AS oy FROM s)"""


def _lines(spark, sf_dir) -> DataFrame:
    run = B.legs(spark, sf_dir).selectExpr("t", "seq", "sum(d * sin(az)) over (partition by t order by seq rows unbounded preceding) as x", "sum(d * cos(az)) over (partition by t order by seq rows unbounded preceding) as y")
    points = run.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    line = F.expr("concat(array(struct(0D as x, 0D as y)), transform(p, q -> struct(q.x as x, q.y as y)))")
    return points.select(F.col("t").alias("id"), line.alias("centerline"), F.lit(4.0).alias("width_m"), F.expr("t % 10").alias("purpose"))


@query("easement_strips", f"{_LINES} SELECT t AS id, seq, round(x + ox + 1e-9, 4) AS lx, round(y + oy + 1e-9, 4) AS ly, round(x - ox + 1e-9, 4) AS rx, round(y - oy + 1e-9, 4) AS ry FROM o WHERE NOT (x <> x)")
def easement_strips(spark, sf_dir) -> DataFrame:
    strips = E.easement_strips(_lines(spark, sf_dir))
    n = F.expr("(size(ring) - 1) div 2")
    rows = strips.select("id", "ring", F.posexplode(F.slice("ring", F.lit(1), n.cast("int"))).alias("seq", "l")).withColumn("r", F.get("ring", F.size("ring") - 2 - F.col("seq")))
    return rows.select("id", "seq", *[F.round(F.col(f"{s}.{c}") + 1e-9, 4).alias(f"{s}{c}") for s in "lr" for c in "xy"])


@query(
    "encumbered_area",
    f"""{_LINES}, q AS (SELECT t, x + ox AS ax, y + oy AS ay, lead(x + ox) OVER w AS ex, lead(y + oy) OVER w AS ey, lead(x - ox) OVER w AS cx, lead(y - oy) OVER w AS cy, x - ox AS dx, y - oy AS dy FROM o WINDOW w AS (PARTITION BY t ORDER BY seq)),
a AS (SELECT t, abs(sum(((cx - ax) * (dy - ey) - (dx - ex) * (cy - ay)) / 2)) AS area FROM q WHERE ex IS NOT NULL GROUP BY t) SELECT t % 10 AS purpose, round(sum(area), 2) AS area FROM a GROUP BY t % 10""",
)
def encumbered_area(spark, sf_dir) -> DataFrame:
    return E.encumbered_area(_lines(spark, sf_dir), ["purpose"]).select("purpose", F.round("area", 2).alias("area"))


#: Straight easements over the plane of parcels, one for each order: along x or along y.
_STRIPS = f"""WITH {B.PARCELS_SQL}, e AS (SELECT o_orderkey AS id, (o_custkey * 613 + o_orderkey * 7) % side AS x, (o_orderkey * 7577) % side AS y, 30.0 + o_orderkey % 50 AS len, 4.0 + o_custkey % 3 * 2 AS w, o_orderkey % 2 = 0 AS flat FROM orders, side),
st AS (SELECT id, CASE WHEN flat THEN x::DOUBLE ELSE x - w / 2 END AS x0, CASE WHEN flat THEN y - w / 2 ELSE y::DOUBLE END AS y0, CASE WHEN flat THEN x + len ELSE x + w / 2 END AS x1, CASE WHEN flat THEN y + w / 2 ELSE y + len END AS y1 FROM e)"""


def _straight(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    side = orders.agg((40 * F.ceil(F.sqrt(F.count("*")))).cast("long").alias("side"))
    e = orders.crossJoin(F.broadcast(side)).selectExpr("o_orderkey as id", "cast((o_custkey * 613 + o_orderkey * 7) % side as double) as x", "cast((o_orderkey * 7577) % side as double) as y", "30.0D + o_orderkey % 50 as len", "4.0D + o_custkey % 3 * 2 as width_m", "o_orderkey % 2 = 0 as flat")
    return e.selectExpr("id", "array(struct(x as x, y as y), if(flat, struct(x + len as x, y as y), struct(x as x, y + len as y))) as centerline", "width_m")


@query(
    "easement_conflicts",
    f"""{_STRIPS}, k AS (SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small
  FROM st a JOIN st b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT a, b, round(area, 3) AS area, CASE WHEN area >= 0.95 * small THEN 'containment' ELSE 'overlap' END AS severity FROM k WHERE area >= 0.01""",
)
def easement_conflicts(spark, sf_dir) -> DataFrame:
    return E.easement_conflicts(_straight(spark, sf_dir), 64.0).withColumn("area", F.round("area", 3))


@query(
    "encumbered_area_net",
    f"""{_STRIPS}, cx AS (SELECT id, y0, y1, unnest(range(ceil(x0 / 3 - 0.5)::BIGINT, ceil(x1 / 3 - 0.5)::BIGINT)) AS i FROM st), c AS (SELECT DISTINCT i, unnest(range(ceil(y0 / 3 - 0.5)::BIGINT, ceil(y1 / 3 - 0.5)::BIGINT)) AS j FROM cx),
px AS (SELECT id, y0, y1, unnest(range(ceil(x0 / 3 - 0.5)::BIGINT, ceil(x1 / 3 - 0.5)::BIGINT)) AS i FROM parcels), p AS (SELECT id, i, unnest(range(ceil(y0 / 3 - 0.5)::BIGINT, ceil(y1 / 3 - 0.5)::BIGINT)) AS j FROM px)
SELECT p.id AS parcel, count(*) * 9.0::DOUBLE AS area FROM c JOIN p USING (i, j) GROUP BY p.id""",
)
def encumbered_area_net(spark, sf_dir) -> DataFrame:
    return E.encumbered_area_net(B.parcels(spark, sf_dir), _straight(spark, sf_dir), 3.0, 40.0)

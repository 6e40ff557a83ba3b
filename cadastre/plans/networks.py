"""Queries of network adjustment: every order is a network, its line items are stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.operators import network
from cadastre.operators import observations as O
from cadastre.plans import bindings as B
from cadastre.plans.registry import query
from cadastre.plans.traverse import r

_W = "WITH " + B.LEGS_SQL

#: Stations in a row, observed one after the other in turns of five kinds.
_NET = f"""{_W}, pts AS (SELECT t AS net, seq AS id, seq AS ord, d * 10 + seq * 60.0 AS x, (l_partkey % 100)::DOUBLE AS y, (l_suppkey % 50)::DOUBLE AS z, seq <= l_partkey % 3 AS fixed FROM legs),
obs AS (SELECT t AS net, seq AS obs, ['azimuth', 'horizontal_distance', 'slope_distance', 'height_difference', 'gnss', 'note'][1 + l_partkey % 6] AS kind, seq AS from_pt, seq + 1 AS to_pt,
  CASE WHEN l_partkey % 6 = 0 THEN radians(l_suppkey % 360) ELSE 40 + l_suppkey % 37 END AS value, (l_suppkey % 9)::DOUBLE AS vx, CASE WHEN l_partkey % 4 > 0 THEN 0.01 * (1 + l_partkey % 3) END AS sigma, l_suppkey % 13 = 0 AS rejected FROM legs)"""


def _points(spark, sf_dir) -> DataFrame:
    return B.legs(spark, sf_dir).selectExpr("t as net", "seq as id", "seq as ord", "d * 10 + seq * 60.0D as x", "cast(l_partkey % 100 as double) as y", "cast(l_suppkey % 50 as double) as z", "seq <= l_partkey % 3 as fixed")


def _obs(spark, sf_dir) -> DataFrame:
    kind = "element_at(array('azimuth', 'horizontal_distance', 'slope_distance', 'height_difference', 'gnss', 'note'), cast(1 + l_partkey % 6 as int)) as kind"
    value = "if(l_partkey % 6 = 0, radians(l_suppkey % 360), cast(40 + l_suppkey % 37 as double)) as value"
    v = "cast(l_suppkey % 9 as double)"
    return B.legs(spark, sf_dir).selectExpr("t as net", "seq as obs", kind, "seq as from_pt", "seq + 1 as to_pt", value, f"array({v}, {v} + 1, {v} + 2) as vector", "if(l_partkey % 4 > 0, 0.01D * (1 + l_partkey % 3), null) as sigma", "l_suppkey % 13 = 0 as rejected")


@query("usable_observations", f"{_NET} SELECT net, obs, kind FROM obs WHERE kind <> 'note' AND NOT rejected")
def usable_observations(spark, sf_dir) -> DataFrame:
    return O.usable_observations(_obs(spark, sf_dir)).select("net", "obs", "kind")


_AXES = "(VALUES ('x'), ('y'), ('z')) v(axis)"
_RANKED = "ranked AS (SELECT *, sum(fixed::INT) OVER (PARTITION BY net) AS n_fixed, row_number() OVER (PARTITION BY net ORDER BY NOT fixed, ord) AS rank FROM pts)"
_FREE = f"{_RANKED}, free AS (SELECT net, id, axis FROM ranked, {_AXES} WHERE NOT CASE WHEN n_fixed >= 2 THEN fixed ELSE rank = 1 OR (rank = 2 AND fixed AND axis = 'x') END)"


@query("free_params", f"{_NET}, {_FREE} SELECT net, id, axis FROM free")
def free_params(spark, sf_dir) -> DataFrame:
    return network.free_params(_points(spark, sf_dir))


@query(
    "jacobian_rows",
    f"""{_NET}, {_FREE}, j AS (SELECT o.*, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS f, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS s
  FROM obs o JOIN pts p ON p.net = o.net AND p.id = o.from_pt JOIN pts q ON q.net = o.net AND q.id = o.to_pt WHERE kind <> 'note' AND NOT rejected),
k AS (SELECT net, obs, from_pt, to_pt, kind, 0 AS part, CASE kind WHEN 'azimuth' THEN dy / (f * f) WHEN 'horizontal_distance' THEN dx / f WHEN 'slope_distance' THEN dx / s ELSE 0 END AS cx,
    CASE kind WHEN 'azimuth' THEN -dx / (f * f) WHEN 'horizontal_distance' THEN dy / f WHEN 'slope_distance' THEN dy / s ELSE 0 END AS cy, CASE kind WHEN 'slope_distance' THEN dz / s WHEN 'height_difference' THEN 1 ELSE 0 END AS cz,
    CASE kind WHEN 'azimuth' THEN atan2(sin(value - atan2(dx, dy)), cos(value - atan2(dx, dy))) WHEN 'horizontal_distance' THEN value - f WHEN 'slope_distance' THEN value - s ELSE value - dz END AS misclosure, sigma FROM j WHERE kind <> 'gnss'
  UNION ALL SELECT net, obs, from_pt, to_pt, kind, part, (part = 0)::INT, (part = 1)::INT, (part = 2)::INT, vx + part - CASE part WHEN 0 THEN dx WHEN 1 THEN dy ELSE dz END, sigma FROM j, (VALUES (0), (1), (2)) v(part) WHERE kind = 'gnss'),
u AS (SELECT net, obs, part, CASE side WHEN 1 THEN to_pt ELSE from_pt END AS id, axis, side * CASE axis WHEN 'x' THEN cx WHEN 'y' THEN cy ELSE cz END AS coef, misclosure,
    1 / coalesce(sigma, CASE kind WHEN 'azimuth' THEN radians(0.001) WHEN 'height_difference' THEN 0.002 ELSE 0.005 END) AS root FROM k, {_AXES}, (VALUES (1), (-1)) w(side))
SELECT net, obs, part, id, axis, round(coef, 6) + 0.0 AS coef, round(misclosure, 6) + 0.0 AS misclosure, round(root, 2) AS root_weight FROM u JOIN free USING (net, id, axis) WHERE coef <> 0 AND isfinite(coef)""",
)
def jacobian_rows(spark, sf_dir) -> DataFrame:
    points = _points(spark, sf_dir)
    rows = network.jacobian_rows(points, _obs(spark, sf_dir), network.free_params(points))
    return rows.select("net", "row.obs", "row.part", "id", "axis", r("coef").alias("coef"), r("misclosure").alias("misclosure"), F.round(F.sqrt("weight"), 2).alias("root_weight"))


#: A point seen from stations around it, by distances; the first three of every order's line items and more stand all around.
_SEEN = f"""{_W}, s AS (SELECT t AS net, seq, 100.0 + t % 50 AS px, 100.0 + t % 70 AS py, (80 + d) * sin(radians(seq * 97 + l_partkey % 30)) AS ox, (80 + d) * cos(radians(seq * 97 + l_partkey % 30)) AS oy, 80 + d + (l_partkey % 7 - 3) * 0.001::DOUBLE AS value FROM legs),
st AS (SELECT *, px + ox AS x, py + oy AS y, count(*) OVER (PARTITION BY net) AS n FROM s), c0 AS (SELECT DISTINCT net, px + 3 AS x, py - 2 AS y FROM st WHERE n >= 2)"""


def _turn(k: int) -> str:
    rows = f"SELECT net, c.x, c.y, (c.x - st.x) / d AS a, (c.y - st.y) / d AS b, value - d AS l FROM (SELECT st.*, sqrt((c.x - st.x) ** 2 + (c.y - st.y) ** 2) AS d FROM st JOIN c{k} c USING (net)) st JOIN c{k} c USING (net)"
    sums = f"SELECT net, x, y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * l) AS al, sum(b * l) AS bl, sum(l * l) AS ll, count(*) AS n FROM ({rows}) GROUP BY net, x, y"
    return f"c{k + 1} AS (SELECT net, x + (bb * al - ab * bl) / (aa * bb - ab * ab) AS x, y + (aa * bl - ab * al) / (aa * bb - ab * ab) AS y, bb / (aa * bb - ab * ab) AS qxx, ll, n FROM ({sums}))"


_FIT = _SEEN + "".join(f", {_turn(k)}" for k in range(6))


def _seen(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stations 1, 2, .. and the point 0 of each network, its distances, and the point's free coordinates."""
    s = B.legs(spark, sf_dir).selectExpr("t as net", "seq", "100.0D + t % 50 as px", "100.0D + t % 70 as py", "d", "radians(seq * 97 + l_partkey % 30) as a", "80 + d + (l_partkey % 7 - 3) * 0.001D as value")
    stations = s.selectExpr("net", "seq as id", "px + (80 + d) * sin(a) as x", "py + (80 + d) * cos(a) as y", "0.0D as z")
    new = s.selectExpr("net", "0 as id", "px + 3 as x", "py - 2 as y", "0.0D as z").distinct()
    obs = s.selectExpr("net", "seq as obs", "'horizontal_distance' as kind", "seq as from_pt", "0 as to_pt", "value", "cast(null as array<double>) as vector", "0.005D as sigma", "false as rejected")
    return stations.unionByName(new), obs, new.selectExpr("net", "id", "explode(array('x', 'y')) as axis")


def _adjusted(spark, sf_dir):
    points, obs, free = _seen(spark, sf_dir)
    return *network.adjust_networks(points, obs, free), obs, free


#: Networks of one station have fewer rows than coordinates; on two stations' line the normal matrix has no inverse: both are left out by the SQL's own rules.
@query("adjust_networks", f"{_FIT} SELECT net, round(x, 5) AS x, round(y, 5) AS y FROM c6 UNION ALL SELECT net, NULL, NULL FROM st WHERE n < 2")
def adjust_networks(spark, sf_dir) -> DataFrame:
    points, _, rejects, _, _ = _adjusted(spark, sf_dir)
    return points.where("id = 0").select("net", F.round("x", 5).alias("x"), F.round("y", 5).alias("y")).unionByName(rejects.select("net"), allowMissingColumns=True)


@query("point_sigmas", f"{_FIT} SELECT net, round(0.005 * sqrt(qxx), 6) AS sigma_x FROM c6")
def point_sigmas(spark, sf_dir) -> DataFrame:
    _, cofactors, _, _, _ = _adjusted(spark, sf_dir)
    own = network.point_sigmas(cofactors.where("i.id = 0 and i.axis = 'x'"))
    return own.select("net", F.round("sigma", 6).alias("sigma_x"))


#: The chi-square distribution at ll / 0.005^2 by its series, for any redundancy; far above its mean it is over 0.975 anyway.
_CHI = """chi AS (SELECT net, n - 2 AS redundancy, (n - 2) / 2.0::DOUBLE AS a, ll / (0.005::DOUBLE * 0.005::DOUBLE) / 2 AS h FROM c7),
cdf AS (SELECT net, redundancy, CASE WHEN redundancy < 1 OR h <= 0 THEN 0 WHEN h > a + 20 * sqrt(a) + 20 THEN 1 ELSE
  (SELECT sum(exp((a + k) * ln(h) - h - lgamma(a + k + 1))) FROM range(0, (h + 20 * sqrt(h) + 60)::BIGINT) t(k)) END AS p FROM chi)"""


@query("chi_square_gate", f"{_FIT}, {_turn(6)}, {_CHI} SELECT net, redundancy, redundancy > 0 AND coalesce(p BETWEEN 0.025 AND 0.975, false) AS passes FROM cdf")
def chi_square_gate(spark, sf_dir) -> DataFrame:
    nets = network.network_fits(*_seen(spark, sf_dir))
    return network.chi_square_gate(nets).select("net", "redundancy", "passes")


#: A loop of levels over an order's line items: the misclosure goes to the legs by their variances.
_LEVELS = f"""{_W}, l AS (SELECT t AS net, seq, count(*) OVER (PARTITION BY t) AS n, l_partkey % 9 - 4.0::DOUBLE AS value, 0.002 * (1 + seq % 3) AS sigma FROM legs),
v AS (SELECT *, CASE WHEN seq < n THEN value ELSE 0.01 * (net % 5) - coalesce(sum(value) OVER (PARTITION BY net ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS h FROM l WHERE n >= 3),
w AS (SELECT *, sum(h) OVER (PARTITION BY net) AS off, sum(sigma * sigma) OVER (PARTITION BY net) AS var FROM v)"""


def _levels(spark, sf_dir):
    own = B.legs(spark, sf_dir).selectExpr("t as net", "seq", "count(*) over (partition by t) as n", "l_partkey % 9 - 4.0D as value", "0.002D * (1 + seq % 3) as sigma").where("n >= 3")
    before = "coalesce(sum(value) over (partition by net order by seq rows between unbounded preceding and 1 preceding), 0)"
    own = own.selectExpr("*", f"if(seq < n, value, 0.01D * (net % 5) - {before}) as h")
    points = own.selectExpr("net", "seq as id", "0.0D as x", "0.0D as y", "0.0D as z")
    obs = own.selectExpr("net", "seq as obs", "'height_difference' as kind", "seq as from_pt", "if(seq < n, seq + 1, 1) as to_pt", "h as value", "cast(null as array<double>) as vector", "sigma", "false as rejected")
    return points, obs, own.where("seq > 1").selectExpr("net", "seq as id", "'z' as axis")


@query("adjust_levels", f"{_LEVELS} SELECT net, seq AS id, round(coalesce(sum(h - off * sigma * sigma / var) OVER (PARTITION BY net ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1e-9, 6) + 0.0 AS z FROM w")
def adjust_levels(spark, sf_dir) -> DataFrame:
    points, _, _ = network.adjust_levels(*_levels(spark, sf_dir))
    return points.select("net", "id", r(F.col("z") + 1e-9).alias("z"))


@query("residuals_blunders", f"{_LEVELS} SELECT net, seq AS obs, round(-off * sigma * sigma / var + 1e-9, 6) + 0.0 AS v, round(-off / sqrt(var) + 1e-9, 5) + 0.0 AS standardized, abs(off / sqrt(var)) > 3.29 AS blunder FROM w")
def residuals_blunders(spark, sf_dir) -> DataFrame:
    _, obs, free = _levels(spark, sf_dir)
    points, cofactors, _ = network.adjust_levels(*_levels(spark, sf_dir))
    rows, _ = network.residuals_blunders(points, obs, free, cofactors)
    return rows.select("net", "obs", r(F.col("v") + 1e-9).alias("v"), r(F.col("standardized") + 1e-9, 5).alias("standardized"), "blunder")

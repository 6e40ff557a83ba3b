"""Queries of coordinate geometry and traverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions import cogo
from cadastre.operators import traverse as T
from cadastre.plans.bindings import LEGS_SQL, legs
from cadastre.plans.registry import query

_W = "WITH " + LEGS_SQL
PI = "3.141592653589793"
COMP = f"{_W}, comp AS (SELECT *, d * sin(az) AS dx, d * cos(az) AS dy FROM legs)"


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def a(column: Column | str) -> Column:
    """An azimuth rounded to 6 digits, with a full turn as 0."""
    x = F.round(column, 6)
    return F.when(x == 6.283185, 0.0).otherwise(x + F.lit(0.0))


def _a(sql: str) -> str:
    return f"CASE WHEN round({sql}, 6) = 6.283185 THEN 0.0 ELSE round({sql}, 6) + 0.0 END"


def _norm(sql: str) -> str:
    return f"(({sql}) - floor(({sql}) / {2 * 3.141592653589793!r}) * {2 * 3.141592653589793!r})"


@query(
    "traverse_closure",
    f"""{COMP}, placed AS (SELECT *, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM comp WINDOW w AS (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING)),
sums AS (SELECT t, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(d) AS perimeter, sum((x - dx) * y - x * (y - dy)) / 2 AS area FROM placed GROUP BY t),
c AS (SELECT *, sqrt(sx * sx + sy * sy) AS closure FROM sums)
SELECT t, n, round(sx, 6) + 0.0 AS dx, round(sy, 6) + 0.0 AS dy, round(closure, 6) + 0.0 AS closure, round(perimeter, 6) AS perimeter, round(area, 3) + 0.0 AS area,
       CASE WHEN closure >= 1e-6 THEN round(perimeter / closure, 4) END AS ratio, CASE WHEN closure >= 1e-6 THEN {_a(_norm('atan2(sx, sy)'))} END AS closure_az FROM c""",
)
def traverse_closure(spark, sf_dir) -> DataFrame:
    c = T.traverse_closure(legs(spark, sf_dir))
    return c.select("t", "n", r("dx").alias("dx"), r("dy").alias("dy"), r("closure").alias("closure"), F.round("perimeter", 6).alias("perimeter"), r("area", 3).alias("area"), F.round("ratio", 4).alias("ratio"), a("closure_az").alias("closure_az"))


@query("traverse_coordinates", f"{COMP} SELECT t, seq, round(sum(dx) OVER w, 6) + 0.0 AS x, round(sum(dy) OVER w, 6) + 0.0 AS y FROM comp WINDOW w AS (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def traverse_coordinates(spark, sf_dir) -> DataFrame:
    return T.traverse_coordinates(legs(spark, sf_dir)).select("t", "seq", r("x").alias("x"), r("y").alias("y"))


@query("area_by_dmd", f"{COMP}, m AS (SELECT *, 2 * sum(dx) OVER (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING) - dx AS dmd FROM comp) SELECT t, round(sum(dmd * dy) / 2, 3) + 0.0 AS area FROM m GROUP BY t")
def area_by_dmd(spark, sf_dir) -> DataFrame:
    return T.area_by_dmd(legs(spark, sf_dir)).select("t", r("area", 3).alias("area"))


ADJUSTED = {
    "compass": f"{COMP}, tot AS (SELECT *, sum(dx) OVER p AS sx, sum(dy) OVER p AS sy, sum(d) OVER p AS len FROM comp WINDOW p AS (PARTITION BY t)), adj AS (SELECT *, dx - sx * (d / len) AS ax, dy - sy * (d / len) AS ay FROM tot WHERE len > 0)",
    "transit": f"{COMP}, tot AS (SELECT *, sum(dx) OVER p AS sx, sum(dy) OVER p AS sy, sum(abs(dx)) OVER p AS tx, sum(abs(dy)) OVER p AS ty FROM comp WINDOW p AS (PARTITION BY t)), adj AS (SELECT *, dx - CASE WHEN tx > 0 THEN sx * abs(dx) / tx ELSE 0 END AS ax, dy - CASE WHEN ty > 0 THEN sy * abs(dy) / ty ELSE 0 END AS ay FROM tot)",
}
_POSITIONS = "SELECT t, seq, round(ax, 5) + 0.0 AS adj_dx, round(ay, 5) + 0.0 AS adj_dy, round(sum(ax) OVER w, 5) + 0.0 AS adj_x, round(sum(ay) OVER w, 5) + 0.0 AS adj_y, round(sqrt(ax * ax + ay * ay), 5) AS adj_d FROM adj WINDOW w AS (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def _positions(at: DataFrame) -> DataFrame:
    return at.select("t", "seq", *[r(c, 5).alias(c) for c in ("adj_dx", "adj_dy", "adj_x", "adj_y")], F.round("adj_d", 5).alias("adj_d"))


@query("adjust_compass", f"{ADJUSTED['compass']} {_POSITIONS}")
def adjust_compass(spark, sf_dir) -> DataFrame:
    return _positions(T.adjust_compass(legs(spark, sf_dir)))


@query("adjust_transit", f"{ADJUSTED['transit']} {_POSITIONS}")
def adjust_transit(spark, sf_dir) -> DataFrame:
    return _positions(T.adjust_transit(legs(spark, sf_dir)))


_CLOSED = "SELECT t, '{m}' AS method, sum({x}) AS sx, sum({y}) AS sy, sum(sqrt({x} * {x} + {y} * {y})) AS perimeter FROM {f} GROUP BY t"
_REPORT = (
    f"{ADJUSTED['compass']}, tot2 AS (SELECT *, sum(abs(dx)) OVER (PARTITION BY t) AS tx, sum(abs(dy)) OVER (PARTITION BY t) AS ty, sum(dx) OVER (PARTITION BY t) AS sx, sum(dy) OVER (PARTITION BY t) AS sy FROM comp),"
    " adj2 AS (SELECT *, dx - CASE WHEN tx > 0 THEN sx * abs(dx) / tx ELSE 0 END AS ax, dy - CASE WHEN ty > 0 THEN sy * abs(dy) / ty ELSE 0 END AS ay FROM tot2), u AS ("
    + " UNION ALL ".join(_CLOSED.format(m=m, x=x, y=y, f=f) for m, x, y, f in (("unadjusted", "dx", "dy", "comp"), ("compass", "ax", "ay", "adj"), ("transit", "ax", "ay", "adj2")))
    + ") SELECT t, method, round(sqrt(sx * sx + sy * sy), 5) + 0.0 AS closure, round(perimeter, 5) AS perimeter, sqrt(sx * sx + sy * sy) < 1e-6 OR perimeter >= 10000 * sqrt(sx * sx + sy * sy) AS passes FROM u"
)


@query("closure_report", _REPORT)
def closure_report(spark, sf_dir) -> DataFrame:
    return T.closure_report(legs(spark, sf_dir)).select("t", "method", r("closure", 5).alias("closure"), F.round("perimeter", 5).alias("perimeter"), "passes")


_STANDARDS = ", ".join(f"('{n}', {v})" for n, v in cogo.STANDARDS.items())


@query(
    "classify_closure",
    f"{COMP}, s AS (SELECT t, sum(d) AS p, sqrt(sum(dx) * sum(dx) + sum(dy) * sum(dy)) AS c FROM comp GROUP BY t) SELECT t, standard, c < 1e-6 OR p / c >= needed AS passes FROM s CROSS JOIN (VALUES {_STANDARDS}) v(standard, needed)",
)
def classify_closure(spark, sf_dir) -> DataFrame:
    return T.classify_closure(T.traverse_closure(legs(spark, sf_dir)).select("t", "ratio")).select("t", "standard", "passes")


@query("worst_closures", f"{COMP}, s AS (SELECT t, sum(d) AS p, sqrt(sum(dx) * sum(dx) + sum(dy) * sum(dy)) AS c FROM comp GROUP BY t) SELECT t, round(p / c, 4) AS ratio FROM s WHERE c >= 1e-6 ORDER BY round(p / c, 9), t LIMIT 100")
def worst_closures(spark, sf_dir) -> DataFrame:
    return T.worst_closures(legs(spark, sf_dir), 100).select("t", F.round("ratio", 4).alias("ratio"))


@query(
    "bearing_columns",
    f"{_W} SELECT t, seq, {_a(_norm('az * 3 - 7'))} AS normal, {_a(_norm(f'az + {PI}'))} AS back, round(CASE WHEN {_norm('az - 1')} > {PI} THEN {_norm('az - 1')} - 2 * {PI} ELSE {_norm('az - 1')} END, 6) + 0.0 AS difference FROM legs",
)
def bearing_columns(spark, sf_dir) -> DataFrame:
    az = F.col("az")
    return legs(spark, sf_dir).select("t", "seq", a(cogo.azimuth(az * 3 - 7)).alias("normal"), a(cogo.back_azimuth(az)).alias("back"), r(cogo.azimuth_difference(az, F.lit(1.0))).alias("difference"))


@query("inverse_points", f"{_W} SELECT t, seq, round(sqrt((seq * 3.0 - d) ** 2 + (l_linenumber * 2.0 - d / 2) ** 2), 6) AS distance, {_a(_norm('atan2(seq * 3.0 - d, l_linenumber * 2.0 - d / 2)'))} AS azimuth FROM legs")
def inverse_points(spark, sf_dir) -> DataFrame:
    distance, az = cogo.inverse(F.col("d"), F.col("d") / 2, F.col("seq") * 3.0, F.col("l_linenumber") * 2.0)
    return legs(spark, sf_dir).select("t", "seq", F.round(distance, 6).alias("distance"), a(az).alias("azimuth"))


@query("forward_points", f"{_W} SELECT t, seq, round(l_suppkey + d * sin(az), 6) + 0.0 AS x, round(l_partkey + d * cos(az), 6) + 0.0 AS y FROM legs")
def forward_points(spark, sf_dir) -> DataFrame:
    az, d = F.col("az"), F.col("d")
    return legs(spark, sf_dir).select("t", "seq", r(F.col("l_suppkey") + cogo.departure(az, d)).alias("x"), r(F.col("l_partkey") + cogo.latitude(az, d)).alias("y"))


@query(
    "dms_columns",
    f"""{_W}, q AS (SELECT *, CASE WHEN az <= {PI} / 2 OR az >= 3 * {PI} / 2 THEN 'N' ELSE 'S' END AS ns, CASE WHEN az <= {PI} THEN 'E' ELSE 'W' END AS ew,
  CASE WHEN az <= {PI} / 2 THEN az WHEN az <= {PI} THEN {PI} - az WHEN az <= 3 * {PI} / 2 THEN az - {PI} ELSE 2 * {PI} - az END + seq / 1000.0 AS ang FROM legs),
k AS (SELECT *, round(degrees(abs(ang)) * 3600000)::BIGINT AS m FROM q)
SELECT t, seq, ns, ew, m // 3600000 AS deg, (m % 3600000) // 60000 AS min, round((m % 60000) / 1000.0, 3) AS sec FROM k""",
)
def dms_columns(spark, sf_dir) -> DataFrame:
    ns, angle, ew = cogo.quadrant_bearing(F.col("az"))
    deg, minute, second = cogo.dms(angle + F.col("seq") / 1000.0)
    return legs(spark, sf_dir).select("t", "seq", ns.alias("ns"), ew.alias("ew"), deg.cast("long").alias("deg"), minute.cast("long").alias("min"), F.round(second, 3).alias("sec"))


_PAIRS = f"{_W}, pairs AS (SELECT a.t, a.az AS az1, b.az AS az2, a.d AS d1, b.d AS d2, a.l_linenumber * 1.0 AS p, b.l_linenumber * 2.0 + 3 AS q FROM legs a JOIN legs b ON a.t = b.t AND a.seq = 1 AND b.seq = 2)"


def pairs(spark, sf_dir) -> DataFrame:
    """The first two legs of each traverse, side by side: one window, no self-join."""
    first = lambda c, i: F.max(F.when(F.col("seq") == i, F.col(c)))
    rows = legs(spark, sf_dir).where("seq <= 2").groupBy("t").agg(*[first(c, i).alias(f"{c}{i}") for c in ("az", "d", "l_linenumber") for i in (1, 2)])
    return rows.where("az2 is not null").withColumns({"p": F.col("l_linenumber1") * 1.0, "q": F.col("l_linenumber2") * 2.0 + 3})


@query(
    "intersect_bearing_bearing",
    f"""{_PAIRS}, k AS (SELECT *, -sin(az1) * cos(az2) + cos(az1) * sin(az2) AS det FROM pairs), s AS (SELECT *, CASE WHEN abs(det) >= 1e-12 THEN ((q - p) * -cos(az2) + (p - q) * sin(az2)) / det END AS u FROM k)
SELECT t, round(p + u * sin(az1), 4) + 0.0 AS x, round(q + u * cos(az1), 4) + 0.0 AS y FROM s""",
)
def intersect_bearing_bearing(spark, sf_dir) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    x, y = cogo.ray_ray(p, q, F.col("az1"), q, p, F.col("az2"))
    return pairs(spark, sf_dir).select("t", r(x, 4).alias("x"), r(y, 4).alias("y"))


@query(
    "intersect_bearing_distance",
    f"""{_PAIRS}, h AS (SELECT *, p * sin(az1) + q * cos(az1) AS half FROM pairs), i AS (SELECT *, half * half - (p * p + q * q - d2 * d2) AS inside FROM h)
SELECT t, round(CASE WHEN inside >= 0 THEN -half - sqrt(greatest(inside, 0)) END, 5) + 0.0 AS t1, round(CASE WHEN inside >= 0 THEN -half + sqrt(greatest(inside, 0)) END, 5) + 0.0 AS t2 FROM i""",
)
def intersect_bearing_distance(spark, sf_dir) -> DataFrame:
    t1, t2 = cogo.ray_circle(F.col("p"), F.col("q"), F.col("az1"), F.lit(0.0), F.lit(0.0), F.col("d2"))
    return pairs(spark, sf_dir).select("t", r(t1, 5).alias("t1"), r(t2, 5).alias("t2"))


@query(
    "intersect_distance_distance",
    f"""{_PAIRS}, b AS (SELECT *, sqrt(p * p + q * q) AS dist FROM pairs), c AS (SELECT *, (d1 * d1 - d2 * d2 + dist * dist) / (2 * dist) AS u FROM b), e AS (SELECT *, d1 * d1 - u * u AS h2 FROM c)
SELECT t, round(u * p / dist + CASE WHEN h2 >= 0 THEN sqrt(greatest(h2, 0)) END * q / dist, 4) + 0.0 AS xa, round(u * q / dist - CASE WHEN h2 >= 0 THEN sqrt(greatest(h2, 0)) END * p / dist, 4) + 0.0 AS ya FROM e""",
)
def intersect_distance_distance(spark, sf_dir) -> DataFrame:
    xa, ya, _, _ = cogo.circle_circle(F.lit(0.0), F.lit(0.0), F.col("d1"), F.col("p"), F.col("q"), F.col("d2"))
    return pairs(spark, sf_dir).select("t", r(xa, 4).alias("xa"), r(ya, 4).alias("ya"))


@query(
    "curve_table",
    f"{_W} SELECT t, seq, round(d * az, 6) AS arc, round(2 * d * sin(az / 2), 6) AS chord, round(d * (1 - cos(az / 2)), 6) AS mid_ordinate, round(degrees(30.48 / d), 6) AS degree FROM legs WHERE d > 0 AND az > 0 AND az < 2 * {PI}",
)
def curve_table(spark, sf_dir) -> DataFrame:
    c = cogo.curve(F.col("d"), F.col("az"))
    return legs(spark, sf_dir).select("t", "seq", *[F.round(c[k], 6).alias(k) for k in ("arc", "chord", "mid_ordinate", "degree")]).where("arc is not null")


_UNITS = ", ".join(f"('{n}', {v!r}::DOUBLE)" for n, v in cogo.UNITS.items())


@query("unit_to_metres", f"{_W}, u AS (SELECT *, ['feet', 'varas', 'chains', 'rods', 'furlongs'][l_linenumber % 5 + 1] AS unit FROM legs) SELECT t, seq, u.unit, round(d * f, 6) AS metres FROM u LEFT JOIN (VALUES {_UNITS}) v(unit, f) ON u.unit = v.unit")
def unit_to_metres(spark, sf_dir) -> DataFrame:
    units = F.broadcast(spark.createDataFrame(list(cogo.UNITS.items()), "unit string, factor double"))
    rows = legs(spark, sf_dir).withColumn("unit", F.element_at(F.array(*map(F.lit, ("feet", "varas", "chains", "rods", "furlongs"))), F.col("l_linenumber") % 5 + 1))
    return rows.join(units, "unit", "left").select("t", "seq", "unit", F.round(F.col("d") * F.col("factor"), 6).alias("metres"))

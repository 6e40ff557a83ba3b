"""Queries of observations, networks, fabric, land descriptions, SQL functions and live feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions.sql import register_functions
from cadastre.operators import deeds, editlog, fabric, network
from cadastre.operators import observations as O
from cadastre.plans import bindings as B
from cadastre.plans.registry import query
from cadastre.plans.traverse import r
from cadastre.sources.tables import load
from cadastre.streaming import live

_W = "WITH " + B.LEGS_SQL


# Observations.

_OBS = """WITH obs AS (
  SELECT user_id AS setup, event_id % 11 AS target, event_id AS line_no, ['HA', 'HA', 'VA', 'VA', 'SD', 'SD', 'HD'][event_id % 7 + 1] AS kind,
         CASE WHEN event_id % 7 < 2 THEN radians(event_id * 17 % 360) WHEN event_id % 7 < 4 THEN radians(80 + event_id % 20) ELSE value END AS value, event_id % 3 * 0.5::DOUBLE AS target_height FROM events),
setups AS (SELECT DISTINCT user_id AS setup, CASE WHEN user_id % 3 > 0 THEN radians(user_id * 7 % 360) END AS backsight, 1.5 + user_id % 2 * 0.1::DOUBLE AS instrument_height FROM events)"""
_LAST = ", ".join(f"arg_max(value, line_no) FILTER (kind = '{k}') AS {k}" for k in ("HA", "VA", "SD", "HD"))


def _shots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = load(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.col("event_id") % 7
    kind = F.when(k < 2, "HA").when(k < 4, "VA").when(k < 6, "SD").otherwise("HD")
    value = F.when(k < 2, F.radians(i * 17 % 360)).when(k < 4, F.radians(80 + i % 20)).otherwise(F.col("value"))
    obs = events.select(F.col("user_id").alias("setup"), (i % 11).alias("target"), i.alias("line_no"), kind.alias("kind"), value.alias("value"), (i % 3 * 0.5).alias("target_height"))
    user = F.col("user_id")
    setups = events.select(user.alias("setup"), F.when(user % 3 > 0, F.radians(user * 7 % 360)).alias("backsight"), (1.5 + user % 2 * 0.1).alias("instrument_height")).distinct()
    return setups, obs


@query(
    "reduce_observations",
    f"""{_OBS}, k AS (SELECT setup, target, {_LAST}, arg_max(target_height, line_no) FILTER (kind = 'SD') AS th FROM obs GROUP BY setup, target)
SELECT setup, target, round(sin(coalesce(backsight, 0) + HA), 6) + 0.0 AS s, round(cos(coalesce(backsight, 0) + HA), 6) + 0.0 AS c, round(coalesce(HD, SD * sin(VA), SD), 4) + 0.0 AS horiz,
       round(CASE WHEN HD IS NOT NULL THEN 0 ELSE coalesce(SD * cos(VA), 0) + instrument_height - th END, 4) + 0.0 AS dz
FROM k JOIN setups USING (setup) WHERE HA IS NOT NULL AND (SD IS NOT NULL OR HD IS NOT NULL)""",
)
def reduce_observations(spark, sf_dir) -> DataFrame:
    legs = O.reduce_observations(*_shots(spark, sf_dir))
    return legs.select("setup", "target", r(F.sin("bearing")).alias("s"), r(F.cos("bearing")).alias("c"), r("horiz", 4).alias("horiz"), r("dz", 4).alias("dz"))


@query(
    "setup_asof",
    """SELECT file, pos, setup, setup_height FROM (
  SELECT *, last_value(CASE WHEN kind = 'setup' THEN station END IGNORE NULLS) OVER w AS setup, last_value(CASE WHEN kind = 'setup' THEN height END IGNORE NULLS) OVER w AS setup_height
  FROM (SELECT user_id AS file, event_id AS pos, CASE WHEN event_id % 5 = 0 THEN 'setup' ELSE 'shot' END AS kind, event_type AS station, value AS height FROM events)
  WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kind = 'shot'""",
)
def setup_asof(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 0, "setup").otherwise("shot")
    return O.setup_asof(load(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), kind.alias("kind"), F.col("event_type").alias("station"), F.col("value").alias("height")))


_FUSED = """WITH fused AS (
  SELECT 'gnss' AS source, c_custkey AS id, c_nationkey AS network, (c_custkey % 100)::DOUBLE AS x, (0.01 + c_custkey % 5 / 100.0) * 1.0 AS sx, (0.02 + c_custkey % 5 / 100.0) * 1.0 AS sz FROM customer
  UNION ALL SELECT 'lidar', s_suppkey, s_nationkey, (s_suppkey % 100)::DOUBLE, (0.01 + s_suppkey % 5 / 100.0) * 2.5, (0.02 + s_suppkey % 5 / 100.0) * 2.5 FROM supplier)"""


def _fused(spark, sf_dir) -> DataFrame:
    def source(table: str, k: str, nation: str) -> DataFrame:
        part = F.col(k) % 5 / 100.0
        sigma = F.array(0.01 + part, 0.01 + part, 0.02 + part)
        return load(spark, sf_dir, table).select(F.col(k).alias("id"), F.col(nation).alias("network"), (F.col(k) % 100).cast("double").alias("x"), sigma.alias("sigma"))

    return O.fuse_sources({"gnss": source("customer", "c_custkey", "c_nationkey"), "lidar": source("supplier", "s_suppkey", "s_nationkey")}, {"lidar": 2.5})


@query("fuse_sources", f"{_FUSED} SELECT source, id, network, x, round(sx, 6) AS sx, round(sz, 6) AS sz FROM fused")
def fuse_sources(spark, sf_dir) -> DataFrame:
    return _fused(spark, sf_dir).select("source", "id", "network", "x", F.round(F.col("sigma")[0], 6).alias("sx"), F.round(F.col("sigma")[2], 6).alias("sz"))


@query("source_counts", f"{_FUSED} SELECT network, source, count(*) AS n FROM fused GROUP BY ROLLUP (network, source)")
def source_counts(spark, sf_dir) -> DataFrame:
    return O.source_counts(_fused(spark, sf_dir))


@query(
    "measure_path",
    f"""{_W}, p AS (SELECT t, seq, d * 10 AS x, (l_partkey % 100)::DOUBLE AS y FROM legs), s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS distance FROM p WINDOW w AS (PARTITION BY t ORDER BY seq))
SELECT t, seq, round(distance, 6) AS distance, round(coalesce(sum(distance) OVER (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING), 0), 6) AS upto FROM s""",
)
def measure_path(spark, sf_dir) -> DataFrame:
    points = B.legs(spark, sf_dir).select("t", "seq", (F.col("d") * 10).alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y"))
    return O.measure_path(points).select("t", "seq", F.round("distance", 6).alias("distance"), F.round("upto", 6).alias("upto"))


# Networks.


@query(
    "normal_equations",
    f"""{_W}, rws AS (SELECT t AS net, seq AS row, seq + k AS param, (2 * k - 1)::DOUBLE AS coef, l_partkey % 7 * 0.001 AS misclosure, 1 / (1 + d) AS weight FROM legs, (VALUES (0), (1)) v(k))
SELECT a.net, a.param AS i, b.param AS j, round(sum(a.weight * a.coef * b.coef), 6) + 0.0 AS value FROM rws a JOIN rws b ON a.net = b.net AND a.row = b.row GROUP BY ALL
UNION ALL SELECT net, param, NULL, round(sum(weight * coef * misclosure), 6) + 0.0 FROM rws GROUP BY ALL""",
)
def normal_equations(spark, sf_dir) -> DataFrame:
    rows = B.legs(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select(F.col("t").alias("net"), F.col("seq").alias("row"), (F.col("seq") + F.col("k")).alias("param"), (2.0 * F.col("k") - 1).alias("coef"), (F.col("l_partkey") % 7 * 0.001).alias("misclosure"), (1 / (1 + F.col("d"))).alias("weight"))
    return network.normal_equations(rows).select("net", "i", "j", r("value").alias("value"))


_COV = f"{_W}, cov AS (SELECT t, seq, 0.01 + l_partkey % 13 * 0.001 AS sxx, 0.012 + l_suppkey % 11 * 0.001 AS syy, (l_partkey % 7 - 3.5) * 0.002 AS sxy FROM legs)"


def _cov(spark, sf_dir) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return B.legs(spark, sf_dir).select("t", "seq", (0.01 + p % 13 * 0.001).alias("sxx"), (0.012 + s % 11 * 0.001).alias("syy"), ((p % 7 - 3.5) * 0.002).alias("sxy"))


@query(
    "error_ellipses",
    f"""{_COV}, e AS (SELECT *, (sxx + syy) / 2 AS m, sqrt(((sxx - syy) / 2) ** 2 + sxy * sxy) AS q FROM cov)
SELECT t, seq, round(2.45 * sqrt(greatest(m + q, 0)), 6) AS a, round(2.45 * sqrt(greatest(m - q, 0)), 6) AS b, round(atan2(2 * sxy, sxx - syy) / 2, 6) + 0.0 AS theta FROM e""",
)
def error_ellipses(spark, sf_dir) -> DataFrame:
    return network.error_ellipses(_cov(spark, sf_dir)).select("t", "seq", r("a").alias("a"), r("b").alias("b"), r("theta").alias("theta"))


# Fabric.

_TILES = "WITH tiles AS (SELECT o_orderkey AS id, 20 * (o_orderkey % 100) AS x, 20 * (o_orderkey // 100) AS y FROM orders)"


def _tiles(spark, sf_dir) -> DataFrame:
    x, y = 20.0 * (F.col("o_orderkey") % 100), 20.0 * F.floor(F.col("o_orderkey") / 100)
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(20, 0), corner(20, 20), corner(0, 20), corner(0, 0))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ring.alias("ring"))


@query("adjacency", f"{_TILES} SELECT a.id AS a, b.id AS b, 1::BIGINT AS shared FROM tiles a JOIN tiles b ON b.x = a.x + 20 AND b.y = a.y UNION ALL SELECT a.id, b.id, 1 FROM tiles a JOIN tiles b ON b.x = a.x AND b.y = a.y + 20")
def adjacency(spark, sf_dir) -> DataFrame:
    return fabric.adjacency(fabric.fabric_edges(_tiles(spark, sf_dir), 0.01))


_SIDES = f"""{_TILES}, sides AS (SELECT id, x AS px, y AS py, x + 20 AS qx, y AS qy FROM tiles UNION ALL SELECT id, x, y + 20, x + 20, y + 20 FROM tiles
  UNION ALL SELECT id, x, y, x, y + 20 FROM tiles UNION ALL SELECT id, x + 20, y, x + 20, y + 20 FROM tiles)"""


def _ends(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select(*keep, *[F.round(F.col(f"edge.{e}.{c}") * 0.01).cast("long").alias(e + c) for e in "pq" for c in "xy"])


@query("remove_parcels", f"{_SIDES} SELECT DISTINCT px, py, qx, qy FROM sides WHERE id % 3 <> 0")
def remove_parcels(spark, sf_dir) -> DataFrame:
    edges = fabric.fabric_edges(_tiles(spark, sf_dir), 0.01)
    gone = edges.select("id").where("id % 3 = 0").distinct()
    return _ends(fabric.gc_orphans(fabric.remove_parcels(edges, gone), edges.select("edge").distinct()))


@query("merge_outline", f"{_SIDES} SELECT id // 4 AS grp, px, py, qx, qy FROM sides GROUP BY ALL HAVING count(*) = 1")
def merge_outline(spark, sf_dir) -> DataFrame:
    tiles = _tiles(spark, sf_dir)
    return _ends(fabric.merge_outline(fabric.fabric_edges(tiles, 0.01), tiles.select("id", F.floor(F.col("id") / 4).alias("grp"))), "grp")


@query(
    "hausdorff",
    f"""WITH {B.PARCELS_SQL}, a AS (SELECT id, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM parcels), b AS (SELECT id, x + id % 7 AS x, y + id % 5 * 2 AS y FROM a WHERE x + y > 0),
d AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM a JOIN b USING (id)),
f AS (SELECT id, min(d) AS m FROM d GROUP BY id, ax, ay UNION ALL SELECT id, min(d) FROM d GROUP BY id, bx, b_y) SELECT id, round(max(m), 6) AS distance FROM f GROUP BY id""",
)
def hausdorff(spark, sf_dir) -> DataFrame:
    open_ring = F.filter(F.slice("ring", 1, 4), lambda p: p["x"] + p["y"] > 0)
    moved = F.transform(open_ring, lambda p: F.struct((p["x"] + F.col("id") % 7).alias("x"), (p["y"] + F.col("id") % 5 * 2).alias("y")))
    return B.parcels(spark, sf_dir).select("id", F.round(fabric.hausdorff(F.slice("ring", 1, 4), moved), 6).alias("distance"))


@query(
    "feature_summary",
    """SELECT o_custkey % 50 AS file, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS layers, min(o_totalprice) AS x0, min(o_orderkey)::DOUBLE AS y0, max(o_totalprice) AS x1, max(o_orderkey)::DOUBLE AS y1 FROM orders GROUP BY ALL""",
)
def feature_summary(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), F.col("o_orderpriority").alias("layer"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").cast("double").alias("y"))
    return fabric.feature_summary(rows).withColumn("layers", F.array_join("layers", "|"))


@query("distinct_warnings", "SELECT user_id AS file, event_type AS warning, min(event_id) AS pos FROM events GROUP BY ALL")
def distinct_warnings(spark, sf_dir) -> DataFrame:
    return fabric.distinct_warnings(load(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("warning"), F.col("event_id").alias("pos")))


# Land descriptions.

_SPELT = ("feet", "meters", "chains", "rods", "varas")


def _deeds(spark, sf_dir) -> DataFrame:
    """Deeds from traverse legs; every seventh call of a kind is a curve, every eleventh gives no distance."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    deg = (p % 90).cast("string")
    bearing = F.concat(F.element_at(F.array(F.lit("N "), F.lit("S ")), (s % 2 + 1).cast("int")), deg, F.lit("°"), (p % 60).cast("string"), F.lit("'30\" "), F.element_at(F.array(F.lit("E"), F.lit("W")), (n % 2 + 1).cast("int")))
    unit = F.element_at(F.array(*map(F.lit, _SPELT)), (n % 5 + 1).cast("int"))
    line = F.concat(bearing, F.lit(", a distance of "), F.col("d").cast("int").cast("string"), F.lit(" "), unit)
    call = F.when(p % 7 == 0, F.concat(F.lit("along a curve to the right, having a radius of "), F.col("d").cast("int").cast("string"), F.lit(" feet, a central angle of "), deg, F.lit("°30', and a chord bearing "), bearing)).when(p % 11 == 0, F.concat(bearing, F.lit(" to a stone"))).otherwise(line)
    texts = B.legs(spark, sf_dir).groupBy(F.col("t").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("seq", call.alias("call")))).alias("calls"))
    return texts.select("doc", F.concat(F.lit("Beginning at an iron pin;\n THENCE "), F.array_join("calls.call", ";\n  thence ")).alias("text"))


_FACTOR = "[0.3048, 1.0, 20.1168, 5.0292, 0.847396][l_linenumber % 5 + 1]"


@query(
    "parse_deeds",
    f"""{_W}, c AS (SELECT t AS doc, seq, l_partkey % 7 = 0 AS curve, l_partkey % 11 = 0 AS vague, d, l_linenumber, l_suppkey % 2 = 0 AS north, l_linenumber % 2 = 0 AS east, radians(l_partkey % 90 + l_partkey % 60 / 60.0 + 30 / 3600.0) AS q, radians(l_partkey % 90 + 0.5) AS delta FROM legs)
SELECT doc, seq::INTEGER AS seq, CASE WHEN curve THEN 'curve' WHEN vague THEN 'unparsed' ELSE 'line' END AS kind, round(CASE WHEN east THEN 1 ELSE -1 END * sin(q), 6) + 0.0 AS east, round(CASE WHEN north THEN 1 ELSE -1 END * cos(q), 6) + 0.0 AS north,
       CASE WHEN curve THEN round(2 * d * 0.3048 * sin(delta / 2), 6) WHEN NOT vague THEN round(d * {_FACTOR}, 6) END AS metres, CASE WHEN curve THEN round(d * 0.3048, 6) END AS radius, CASE WHEN curve THEN round(d * 0.3048 * delta, 6) END AS arc, CASE WHEN curve THEN true END AS clockwise FROM c""",
)
def parse_deeds(spark, sf_dir) -> DataFrame:
    calls = deeds.parse_deeds(_deeds(spark, sf_dir))
    return calls.select("doc", "seq", "kind", r(F.sin("az")).alias("east"), r(F.cos("az")).alias("north"), F.round("metres", 6).alias("metres"), F.round("radius", 6).alias("radius"), F.round("arc", 6).alias("arc"), "clockwise")


@query(
    "curve_fill",
    f"""{_W}, c AS (SELECT t, seq, 10 + d AS radius, CASE WHEN seq % 3 = 0 THEN radians(10 + l_partkey % 80) WHEN seq % 3 = 1 THEN 0.5 ELSE 2 * asin(d / 4 / (2 * (10 + d))) END AS delta FROM legs)
SELECT t, seq, round(delta, 6) AS delta, round(radius * delta, 6) AS arc, round(2 * radius * sin(delta / 2), 6) AS chord FROM c""",
)
def curve_fill(spark, sf_dir) -> DataFrame:
    radius, seq = 10 + F.col("d"), F.col("seq") % 3
    curves = B.legs(spark, sf_dir).select("t", "seq", radius.alias("radius"), F.when(seq == 0, F.radians(10 + F.col("l_partkey") % 80)).alias("delta"), F.when(seq == 1, radius * 0.5).alias("arc"), F.when(seq == 2, F.col("d") / 4).alias("chord"))
    return deeds.curve_fill(curves).select("t", "seq", *[F.round(c, 6).alias(c) for c in ("delta", "arc", "chord")])


@query("failed_deeds", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 4 = 1 THEN 'empty' ELSE 'no calls' END AS reason FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 4 < 3")
def failed_deeds(spark, sf_dir) -> DataFrame:
    text = "element_at(array('from the POB thence N 1-30 E 5 feet', ' ', 'a field; thence home', 'thence South 10 degrees West 2 chains to the True Point of Beginning'), cast(o_orderkey % 4 + 1 as int)) as text"
    docs = load(spark, sf_dir, "orders").selectExpr("o_orderkey as doc", text)
    return deeds.failed_deeds(docs, deeds.parse_deeds(docs))


@query("deed_beginnings", "SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'POB' WHEN 1 THEN 'true point of beginning' END AS beginning FROM orders")
def deed_beginnings(spark, sf_dir) -> DataFrame:
    text = "element_at(array('from the POB thence', 'to the true point of beginning', 'beginning at a pin'), cast(o_orderkey % 3 + 1 as int)) as text"
    return deeds.beginnings(load(spark, sf_dir, "orders").selectExpr("o_orderkey as doc", text))


_Q = "['NE', 'NW', 'SE', 'SW']"


def _plss(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    quarter = lambda i: F.element_at(F.array(*map(F.lit, ("NE", "NW", "SE", "SW"))), (i % 4 + 1).cast("int"))
    text = F.concat(F.lit("The "), quarter(k), F.lit(" 1/4 of the "), quarter(F.floor(k / 4)), F.when(k % 2 == 0, " 1/4 of Section ").otherwise("¼ of Section "), k % 36 + 1, F.lit(", Township "), k % 9 + 1, F.lit(" North, Range "), k % 7 + 1, F.when(k % 3 == 0, " West, 6th P.M.").when(k % 3 == 1, " West, Salt Lake P.M.").otherwise(" West"))
    return load(spark, sf_dir, "part").select(k.alias("doc"), text.alias("text"))


@query("parse_plss", f"SELECT p_partkey AS doc, (p_partkey % 9 + 1)::INTEGER AS township, 'N' AS ns, (p_partkey % 7 + 1)::INTEGER AS range, 'W' AS ew, (p_partkey % 36 + 1)::INTEGER AS section, {_Q}[p_partkey % 4 + 1] || ',' || {_Q}[p_partkey // 4 % 4 + 1] AS quarters, ['6th', 'Salt Lake', NULL][1 + p_partkey % 3] AS principal FROM part")
def parse_plss(spark, sf_dir) -> DataFrame:
    return deeds.parse_plss(_plss(spark, sf_dir)).withColumn("quarters", F.array_join("quarters", ","))


@query(
    "plss_boxes",
    f"""WITH k AS (SELECT p_partkey AS doc, p_partkey % 36 // 6 AS rw, p_partkey % 36 % 6 AS c, {_Q}[p_partkey % 4 + 1] AS a, {_Q}[p_partkey // 4 % 4 + 1] AS b FROM part)
SELECT doc, round(1609.344 * (CASE WHEN rw % 2 = 0 THEN 5 - c ELSE c END + CASE WHEN a[2:2] = 'E' THEN 0.5 ELSE 0 END + CASE WHEN b[2:2] = 'E' THEN 0.25 ELSE 0 END), 3)::DOUBLE AS x,
       round(1609.344 * (5 - rw + CASE WHEN a[1:1] = 'N' THEN 0.5 ELSE 0 END + CASE WHEN b[1:1] = 'N' THEN 0.25 ELSE 0 END), 3)::DOUBLE AS y, 402.336::DOUBLE AS side, 40.0::DOUBLE AS acres FROM k""",
)
def plss_boxes(spark, sf_dir) -> DataFrame:
    return deeds.plss_boxes(deeds.parse_plss(_plss(spark, sf_dir))).select("doc", *[F.round(c, 3).alias(c) for c in ("x", "y", "side")], "acres")


# Provenance and SQL functions.


@query("merkle_roots")
def merkle_roots(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    leaf = F.sha2(F.concat_ws(":", i, "event_type").cast("binary"), 256)
    return editlog.merkle_roots(load(spark, sf_dir, "events").select(F.floor(i / 37).alias("grp"), (i % 37).alias("pos"), leaf.alias("hash")))


@query("sql_functions", f"{_W} SELECT t, round(sum(d * sin(az)), 6) + 0.0 AS dx, round(sum(d * cos(az)), 6) + 0.0 AS dy, round(max(sqrt(100 + d * d)), 6) AS reach FROM legs GROUP BY t")
def sql_functions(spark, sf_dir) -> DataFrame:
    register_functions(spark)
    form = "SELECT t, round(sum(cogo_departure(az, d)), 6) + 0.0D AS dx, round(sum(cogo_latitude(az, d)), 6) + 0.0D AS dy, round(max(cogo_distance(0, 0, 10, d)), 6) AS reach FROM {legs} GROUP BY t"
    return spark.sql(form, legs=B.legs(spark, sf_dir))


# Live feeds, over a whole table at once; tests run the same plans as streams.

_FIX = "SELECT user_id AS receiver, ts, value FROM events"


def _fixes(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("receiver"), "ts", "value")


def _meaned(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean": F.round("mean", 4), "begins": F.col("begins").cast("timestamp_ntz"), "ends": F.col("ends").cast("timestamp_ntz")})


@query("stream_fix_rate", f"WITH f AS ({_FIX}) SELECT receiver, time_bucket(INTERVAL 1 HOUR, ts) AS begins, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ends, count(*) AS fixes, round(avg(value), 4) AS mean FROM f GROUP BY ALL")
def stream_fix_rate(spark, sf_dir) -> DataFrame:
    return _meaned(live.fix_rate(_fixes(load(spark, sf_dir, "events"))))


@query(
    "stream_fix_smooth",
    f"""WITH f AS ({_FIX}), w AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS begins FROM f, range(4) v(k))
SELECT receiver, begins, begins + INTERVAL 1 HOUR AS ends, count(*) AS fixes, round(avg(value), 4) AS mean FROM w GROUP BY ALL""",
)
def stream_fix_smooth(spark, sf_dir) -> DataFrame:
    return _meaned(live.fix_smooth(_fixes(load(spark, sf_dir, "events"))))


@query(
    "stream_occupations",
    f"""WITH f AS ({_FIX}), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY receiver ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY receiver ORDER BY ts) AS s FROM g) SELECT receiver, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS fixes, round(avg(value), 4) AS mean FROM s GROUP BY receiver, s""",
)
def stream_occupations(spark, sf_dir) -> DataFrame:
    return _meaned(live.occupations(_fixes(load(spark, sf_dir, "events"))))


@query("stream_lww", f"WITH {B.OPS_SQL} SELECT doc, key, arg_max(value, (ts, actor)) AS value FROM ops GROUP BY doc, key")
def stream_lww(spark, sf_dir) -> DataFrame:
    return live.live_values(B.ops(load(spark, sf_dir, "events")))


@query("stream_op_history", f"WITH {B.OPS_SQL} SELECT op_id, doc, actor, kind FROM ops")
def stream_op_history(spark, sf_dir) -> DataFrame:
    ops = B.ops(load(spark, sf_dir, "events"))
    return live.op_history(ops.unionByName(ops)).select("op_id", "doc", "actor", "kind")


@query("stream_ingest_dedupe", r"SELECT DISTINCT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents")
def stream_ingest_dedupe(spark, sf_dir) -> DataFrame:
    return live.ingest_dedupe(load(spark, sf_dir, "documents"))


@query("stream_closure", f"{_W} SELECT t, count(*) AS n, round(sum(d * sin(az)), 6) + 0.0 AS dx, round(sum(d * cos(az)), 6) + 0.0 AS dy, sum(d) AS perimeter FROM legs GROUP BY t")
def stream_closure(spark, sf_dir) -> DataFrame:
    return live.live_closure(B.legs(spark, sf_dir).select("t", "az", "d")).select("t", "n", r("dx").alias("dx"), r("dy").alias("dy"), "perimeter")

"""Survey tables derived from the given tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastre.sources.tables import load

LEGS_SQL = """legs AS (
  SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq,
         radians((l_partkey * 37 + l_suppkey * 11) % 360) AS az, l_quantity AS d, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traverse legs from line items: an order is a traverse."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    az = F.radians((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 360)
    # Named t after the window, so that rows stand by t already and aren't sent again.
    numbered = load(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(by))
    rows = numbered.select(F.col("l_orderkey").alias("t"), "seq", az.alias("az"), F.col("l_quantity").alias("d"), "l_linenumber", "l_partkey", "l_suppkey")
    return rows


#: Side of the plane of the dense binding, the same at every size of the table.
DENSE = 5000
PARCELS_SQL = """side AS (SELECT (40 * ceil(sqrt(count(*))))::BIGINT AS side FROM orders),
placed AS (SELECT o_orderkey AS id, o_orderkey % 40 AS w, o_custkey % 30 AS h, (o_custkey * 7919 + o_orderkey * 31) % side AS x, (o_orderkey * 104729) % side AS y FROM orders, side),
parcels AS (SELECT id, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + 10 + w)::DOUBLE AS x1, (y + 10 + h)::DOUBLE AS y1 FROM placed)"""


#: The same parcels on a plane that doesn't grow: ten times the rows are ten times as dense.
DENSE_SQL = PARCELS_SQL.replace("(40 * ceil(sqrt(count(*))))::BIGINT AS side FROM orders", f"{DENSE}::BIGINT AS side")


def plane(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """One row with the side of the plane: it grows with the table, or is the same at every size."""
    orders = load(spark, sf_dir, "orders")
    return orders.agg((F.lit(DENSE) if dense else 40 * F.ceil(F.sqrt(F.count("*")))).cast("long").alias("side"))


def parcels(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Rectangular parcels from orders, as closed counter-clockwise rings on plane()."""
    orders, side = load(spark, sf_dir, "orders"), plane(spark, sf_dir, dense)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    placed = orders.select("o_orderkey", "o_custkey").crossJoin(F.broadcast(side))  # one row
    x0, y0 = (c * 7919 + k * 31) % F.col("side"), (k * 104729) % F.col("side")
    box = placed.select(k.alias("id"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 10 + k % 40).cast("double").alias("x1"), (y0 + 10 + c % 30).cast("double").alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return box.select("id", ring.alias("ring"))


LINKS_SQL = """links AS (
  SELECT o_custkey % 300 AS parcel, o_orderkey AS input_pos, o_orderkey AS deed, 'Owner ' || (o_orderkey % 17) || ', Jr.' AS grantor,
         'owner ' || ((o_orderkey * 5 + 3) % 17) || ' LLC' AS grantee, o_orderdate::DATE AS recorded, (o_orderkey % 9000)::VARCHAR AS instrument FROM orders)"""
#: Normalised name, in DuckDB.
NAME_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[,.]', ' ', 'g'), '\b(et\s+ux|et\s+vir|et\s+al|jr|sr|iii?|iv|llc|inc|corp)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deeds with parties from orders, a few hundred parcels."""
    k = F.col("o_orderkey")
    party = lambda name, role: F.struct(name.alias("name"), F.lit(role).alias("role"))
    parties = F.array(party(F.concat(F.lit("Owner "), k % 17, F.lit(", Jr.")), "grantor"), party(F.concat(F.lit("owner "), (k * 5 + 3) % 17, F.lit(" LLC")), "grantee"))
    return load(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("parcel"), k.alias("input_pos"), k.alias("deed"), parties.alias("parties"), F.col("o_orderdate").cast("date").alias("recorded"), (k % 9000).cast("string").alias("instrument"))


CLOUD_SQL = """points AS (
  SELECT l_returnflag AS cloud, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn, l_orderkey * 8 + l_linenumber AS id0,
         (l_partkey * 13 % 1000) / 10.0 + l_discount AS x, (l_suppkey * 29 + l_orderkey) % 1000 / 10.0 AS y, l_extendedprice / 1000 AS z, l_linenumber AS classification,
         hash_id AS id FROM (SELECT *, l_orderkey * 1000000 + l_partkey * 8 + l_linenumber AS hash_id FROM lineitem))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point clouds from line items, one for each return flag."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cloud"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_partkey") * 13 % 1000 / 10.0 + F.col("l_discount")).alias("x"),
        ((F.col("l_suppkey") * 29 + F.col("l_orderkey")) % 1000 / 10.0).alias("y"),
        (F.col("l_extendedprice") / 1000).alias("z"),
        F.col("l_linenumber").alias("classification"),
    )


EVIDENCE_SQL = """evidence AS (
  SELECT l_orderkey AS corner, ['natural_monument', 'artificial_monument_found', 'court_order', 'agreement_line', 'plat_line', 'artificial_monument_record', 'deed_call_bearing', 'deed_call_distance',
    'occupation_line', 'possession_line', 'gnss_observation', 'adjoiner_deed', 'tax_map_line', 'aerial_photo', 'deed_call_quantity'][1 + l_partkey % 15] AS kind,
    100 + l_quantity / 100 AS x, 200 + l_tax AS y, 0.01 + l_discount AS sigma, ['TX', 'CA', 'NY', 'FL', 'GA', 'OH', 'CO', 'VA', 'ZZ'][1 + l_suppkey % 9] AS state FROM lineitem),
weighted AS (
  SELECT *, CASE WHEN state = 'CA' THEN coalesce(map {'artificial_monument_found': 95.0, 'court_order': 80.0, 'plat_line': 55.0, 'artificial_monument_record': 35.0, 'deed_call_bearing': 22.0, 'occupation_line': 15.0, 'possession_line': 12.0, 'tax_map_line': 4.0, 'aerial_photo': 3.0}[kind], base)
                 WHEN state = 'NY' THEN coalesce(map {'court_order': 80.0, 'occupation_line': 65.0, 'possession_line': 18.0}[kind], base) ELSE base END::DOUBLE AS rule_weight
  FROM (SELECT *, map {'natural_monument': 100.0, 'artificial_monument_found': 80.0, 'court_order': 75.0, 'agreement_line': 60.0, 'plat_line': 50.0, 'artificial_monument_record': 40.0, 'deed_call_bearing': 25.0, 'deed_call_distance': 20.0,
    'occupation_line': 18.0, 'possession_line': 15.0, 'gnss_observation': 12.0, 'adjoiner_deed': 10.0, 'tax_map_line': 5.0, 'aerial_photo': 4.0, 'deed_call_quantity': 2.0}[kind] AS base FROM evidence))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner evidence from line items."""
    from cadastre.operators.evidence import KINDS

    states = F.array(*map(F.lit, ("TX", "CA", "NY", "FL", "GA", "OH", "CO", "VA", "ZZ")))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("corner"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 15 + 1).cast("int")).alias("kind"),
        (100 + F.col("l_quantity") / 100).alias("x"),
        (200 + F.col("l_tax")).alias("y"),
        (0.01 + F.col("l_discount")).alias("sigma"),
        F.element_at(states, (F.col("l_suppkey") % 9 + 1).cast("int")).alias("state"),
    )


OPS_SQL = """ops AS (
  SELECT user_id % 20 AS doc, event_id % 50 AS key, event_id % 50 AS vertex, user_id AS actor, ts, value, event_id AS op_id, value AS x, event_id * 0.5::DOUBLE AS y,
         CASE WHEN event_id % 10 < 6 THEN 'insert' WHEN event_id % 10 < 9 THEN 'move' ELSE 'delete' END AS kind FROM events)"""


def ops(events: DataFrame) -> DataFrame:
    """Edit-log operations from events."""
    i = F.col("event_id")
    kind = F.when(i % 10 < 6, "insert").when(i % 10 < 9, "move").otherwise("delete")
    return events.select((F.col("user_id") % 20).alias("doc"), (i % 50).alias("key"), (i % 50).alias("vertex"), F.col("user_id").alias("actor"), "ts", "value", i.alias("op_id"), F.col("value").alias("x"), (i * 0.5).alias("y"), kind.alias("kind"))


SITES_SQL = """sites AS (
  SELECT c_custkey AS id, -160 + (c_custkey * 37 % 950) / 10.0::DOUBLE AS lon, 18 + (c_custkey * 53 % 500) / 10.0::DOUBLE AS lat, c_acctbal / 10 AS h FROM customer)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from customers."""
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k.alias("id"), (-160 + (k * 37 % 950) / 10.0).alias("lon"), (18 + (k * 53 % 500) / 10.0).alias("lat"), (F.col("c_acctbal") / 10).alias("h"))

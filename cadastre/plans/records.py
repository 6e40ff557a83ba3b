"""Queries of title commitments, field codes, lot design and fabric moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import rings
from cadastre.operators import deeds, design, documents, editlog, fabric, title
from cadastre.plans import bindings as B
from cadastre.plans import field
from cadastre.plans.registry import query
from cadastre.plans.traverse import r
from cadastre.sources.tables import load
from cadastre.streaming import live

# Title commitments: an order is an item of its customer's commitment.

_PHRASES = (
    "Payoff of the loan of record", "Release of lien by the county", "A survey of the land", "Judgment of record, Instrument No. ", "Utility easement recorded in ",
    "Oil and gas lease, recording number ", "Taxes for the year, not yet due", "Covenants, recorded on ", "Rights of riparian owners", "Matters shown by the plat",
)
_ITEMS = f"""WITH items AS (SELECT o_custkey AS doc, o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'B1' ELSE 'B2' END AS schedule,
  {list(_PHRASES)}[1 + (o_orderkey // 3) % 10] || o_orderpriority || '; ' || o_orderkey AS text FROM orders)"""


def _items(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.floor(k / 3) % 10).cast("int"))
    text = F.concat(phrase, "o_orderpriority", F.lit("; "), k.cast("string"))
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("item"), F.when(k % 3 == 0, "B1").otherwise("B2").alias("schedule"), text.alias("text"))


def _case(rules: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in rules.items()) + " ELSE 'other' END"


_KINDS = f"{_ITEMS}, kinds AS (SELECT *, CASE WHEN schedule = 'B1' THEN {_case(documents.REQUIREMENTS)} ELSE {_case(documents.EXCEPTIONS)} END AS kind FROM items)"


@query("classify_title_items", f"{_KINDS} SELECT doc, item, schedule, kind FROM kinds")
def classify_title_items(spark, sf_dir) -> DataFrame:
    return documents.classify_items(_items(spark, sf_dir)).select("doc", "item", "schedule", "kind")


@query(
    "title_risk_score",
    f"""{_KINDS} SELECT doc, least(100, sum(CASE WHEN schedule = 'B1' THEN CASE WHEN kind IN {documents.RISKY_REQUIREMENTS} THEN 10 ELSE 2 END
  WHEN kind IN {documents.RISKY_EXCEPTIONS} THEN 10 ELSE 1 END))::BIGINT AS score FROM kinds GROUP BY doc""",
)
def title_risk_score(spark, sf_dir) -> DataFrame:
    return documents.title_risk_score(documents.classify_items(_items(spark, sf_dir)))


@query("recording_refs", "SELECT o_orderkey AS item, CASE WHEN (o_orderkey // 3) % 10 IN (3, 4, 5, 7) THEN o_orderpriority END AS recording_ref FROM orders")
def recording_refs(spark, sf_dir) -> DataFrame:
    return documents.recording_refs(_items(spark, sf_dir)).select("item", "recording_ref")


# Field codes: an event is a shot of its user's crew.

_SHOTS = """WITH shots AS (SELECT user_id AS crew, event_id AS pos, ['+', '', '', '-', 'BEG', '', 'END', '', '', ''][1 + event_id % 10] || upper(event_type) || (event_id % 2)
  || CASE WHEN event_id % 4 = 0 THEN ', bc 12x' ELSE ' PT3 // ' || event_type END AS raw FROM events),
tokens AS (SELECT crew, pos, i - 1 AS seq, parts[i] AS token FROM (SELECT *, regexp_split_to_array(trim(split_part(raw, '//', 1)), '[\\s,]+') AS parts FROM shots), range(1, 9) v(i) WHERE i <= len(parts)),
codes AS (SELECT crew, pos, seq, upper(regexp_extract(token, '(?i)^([+\\-]|BEG|END)?([A-Z]+)([0-9]+)?$', 1)) AS mark, upper(regexp_extract(token, '(?i)^([+\\-]|BEG|END)?([A-Z]+)([0-9]+)?$', 2)) AS code,
  nullif(regexp_extract(token, '(?i)^([+\\-]|BEG|END)?([A-Z]+)([0-9]+)?$', 3), '')::BIGINT AS number FROM tokens WHERE regexp_matches(token, '(?i)^([+\\-]|BEG|END)?([A-Z]+)([0-9]+)?$'))"""


def _codes(spark, sf_dir) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    mark = F.get(F.array(*map(F.lit, ("+", "", "", "-", "BEG", "", "END", "", "", ""))), (i % 10).cast("int"))
    rest = F.when(i % 4 == 0, ", bc 12x").otherwise(F.concat(F.lit(" PT3 // "), kind))
    raw = F.concat(mark, F.upper(kind), (i % 2).cast("string"), rest)
    return documents.parse_field_codes(load(spark, sf_dir, "events").select(F.col("user_id").alias("crew"), i.alias("pos"), raw.alias("raw"))).drop("raw")


@query(
    "parse_field_codes",
    f"{_SHOTS} SELECT crew, pos, seq, code, number, mark IN ('+', 'BEG') AS opens, mark IN ('-', 'END') AS closes, code = 'BC' AS curve_begins, code IN ('EC', 'PT') AS curve_ends FROM codes",
)
def parse_field_codes(spark, sf_dir) -> DataFrame:
    return _codes(spark, sf_dir)


@query(
    "codebook_join",
    f"""{_SHOTS}, book AS (SELECT DISTINCT upper(event_type) AS code, 'line' AS kind, 'L-' || event_type AS layer FROM events WHERE event_type < 'p')
SELECT crew, pos, seq, code, coalesce(CASE WHEN code = 'PT' THEN 'ignore' ELSE kind END, 'point') AS kind, coalesce(CASE WHEN code = 'PT' THEN 'CURVE' ELSE layer END, 'FIELD-UNKNOWN') AS layer FROM codes LEFT JOIN book USING (code)""",
)
def codebook_join(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    book = load(spark, sf_dir, "events").where(kind < "p").select(kind.alias("code"), F.lit("line").alias("kind"), F.concat(F.lit("L-"), kind).alias("layer")).distinct()
    project = spark.createDataFrame([("pt", "ignore", "CURVE")], "code string, kind string, layer string")
    return documents.codebook_join(_codes(spark, sf_dir), book, project).select("crew", "pos", "seq", "code", "kind", "layer")


@query(
    "feature_runs",
    f"""{_SHOTS}, f AS (SELECT *, (mark IN ('+', 'BEG') OR coalesce(lag(mark) OVER w IN ('-', 'END'), false))::INT AS fresh FROM codes WINDOW w AS (PARTITION BY crew, code, number ORDER BY pos, seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY crew, code, number ORDER BY pos, seq)::BIGINT AS run FROM f) SELECT crew, code, number, run, count(*) AS n, min(pos) AS begins, max(pos) AS ends FROM g GROUP BY ALL""",
)
def feature_runs(spark, sf_dir) -> DataFrame:
    return documents.feature_runs(_codes(spark, sf_dir))


@query(
    "json_from_completion",
    """SELECT conv_id, turn, text[strpos(text, '{'):length(text) - strpos(reverse(text), '}') + 1] AS json FROM (SELECT conv_id, turn, '```json' || chr(10) || '{"turn": ' || turn || ', "role": "' || role || '"}' || chr(10) || '```' AS text FROM conversations)""",
)
def json_from_completion(spark, sf_dir) -> DataFrame:
    reply = F.concat(F.lit('```json\n{"turn": '), F.col("turn").cast("string"), F.lit(', "role": "'), F.col("role"), F.lit('"}\n```'))
    return documents.json_from_completion(load(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("text"))).where("valid").select("conv_id", "turn", "json")


# Design and fabric.

_P = "WITH " + B.PARCELS_SQL


def _boxes(spark, sf_dir) -> DataFrame:
    x0, y0, x1, y1 = rings.bounds(F.col("ring"))
    return B.parcels(spark, sf_dir).select("id", "ring", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


_LOTS = f"""{_P}, n AS (SELECT *, greatest(1, least(floor((x1 - x0) / 9), floor((x1 - x0) * (y1 - y0) / 200)))::BIGINT AS n FROM parcels WHERE y1 - y0 >= 15 AND x1 - x0 >= 9 AND (x1 - x0) * (y1 - y0) >= 200),
lots AS (SELECT id, lot, x0 + (lot - 1) * (x1 - x0) / n AS a, x0 + lot * (x1 - x0) / n AS b, y0, y1 FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS lot))"""


@query("design_strip", f"{_LOTS} SELECT id, lot, round(a, 6) AS x0, y0, round(b, 6) AS x1, y1 FROM lots")
def design_strip(spark, sf_dir) -> DataFrame:
    return design.design_strip(_boxes(spark, sf_dir), 9.0, 15.0, 200.0).select("id", "lot", r("x0").alias("x0"), "y0", r("x1").alias("x1"), "y1")


@query(
    "design_totals",
    f"{_LOTS}, t AS (SELECT id, count(*) AS lots, sum((b - a) * (y1 - y0)) AS lot_area FROM lots GROUP BY id) SELECT id, lots, round(lot_area, 3) AS lot_area, round(lots / ((x1 - x0) * (y1 - y0)), 6) AS density FROM t JOIN parcels USING (id)",
)
def design_totals(spark, sf_dir) -> DataFrame:
    parcels = _boxes(spark, sf_dir)
    return design.design_totals(design.design_strip(parcels, 9.0, 15.0, 200.0), parcels).select("id", "lots", r("lot_area", 3).alias("lot_area"), r("density").alias("density"))


@query("geojson_features")
def geojson_features(spark, sf_dir) -> DataFrame:
    return design.to_geojson(_boxes(spark, sf_dir).withColumn("width", F.col("x1") - F.col("x0")), ["width"])


@query("move_nodes", f"{_P} SELECT id, CASE WHEN o_custkey IS NULL THEN x0 ELSE x0 + 5 END AS x, y0 AS y FROM parcels LEFT JOIN (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey % 7 = 0) USING (id)")
def move_nodes(spark, sf_dir) -> DataFrame:
    nodes = _boxes(spark, sf_dir).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return fabric.move_nodes(nodes, nodes.where("id % 7 = 0").select("id", (F.col("x") + 5).alias("x"), "y"))


@query(
    "rubber_sheet",
    f"""{_P}, c AS (SELECT n_nationkey AS ord, n_nationkey * 200.0::DOUBLE AS sx, n_nationkey * 137.0::DOUBLE AS sy, n_regionkey - 2.0::DOUBLE AS dx, n_nationkey % 3 - 1.0::DOUBLE AS dy FROM nation),
d AS (SELECT id, x0, y0, c.*, greatest(sqrt((x0 - sx) ** 2 + (y0 - sy) ** 2), 1e-9) AS d FROM parcels, c)
SELECT id, round(CASE WHEN min(d) <= 1e-9 THEN arg_min(sx + dx, ord) FILTER (d <= 1e-9) ELSE x0 + sum(dx / d / d) / sum(1 / d / d) END, 6) + 0.0 AS x,
       round(CASE WHEN min(d) <= 1e-9 THEN arg_min(sy + dy, ord) FILTER (d <= 1e-9) ELSE y0 + sum(dy / d / d) / sum(1 / d / d) END, 6) + 0.0 AS y FROM d GROUP BY id, x0, y0""",
)
def rubber_sheet(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    sx, sy = k * F.lit(200.0), k * F.lit(137.0)
    controls = load(spark, sf_dir, "nation").select(k.alias("ord"), sx.alias("sx"), sy.alias("sy"), (sx + F.col("n_regionkey") - 2).alias("tx"), (sy + k % 3 - 1).alias("ty"))
    nodes = _boxes(spark, sf_dir).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return fabric.rubber_sheet(nodes, controls).select("id", r("x").alias("x"), r("y").alias("y"))


@query(
    "upsert_parcels",
    """WITH new AS (SELECT o_custkey AS survey, o_orderkey % 10 AS name, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
old AS (SELECT o_custkey AS survey, o_orderkey % 10 AS name, o_orderkey AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)
SELECT * FROM old ANTI JOIN new USING (survey, name) UNION ALL SELECT * FROM new""",
)
def upsert_parcels(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("survey"), (F.col("o_orderkey") % 10).alias("name"), F.col("o_orderkey").alias("version"))
    return title.upsert_parcels(rows.where("version % 2 = 0 or version % 3 = 0"), rows.where("version % 2 = 1"))


# Deeds: boundaries, tracts and training pairs.


@query(
    "deed_boundaries",
    f"""WITH {B.LEGS_SQL}, c AS (SELECT t AS doc, radians(l_partkey % 90 + l_partkey % 60 / 60.0 + 30 / 3600.0) AS q, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS e, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS n,
  CASE WHEN l_partkey % 7 = 0 THEN 2 * d * 0.3048 * sin(radians(l_partkey % 90 + 0.5) / 2) WHEN l_partkey % 11 != 0 THEN d * {field._FACTOR} END AS m FROM legs),
s AS (SELECT doc, count(*) AS n, sum(e * m * sin(q)) AS dx, sum(n * m * cos(q)) AS dy, sum(m) AS p FROM c GROUP BY doc HAVING count(*) = count(m))
SELECT doc, n, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy, round(p, 4) AS perimeter, n + 1 AS corners FROM s""",
)
def deed_boundaries(spark, sf_dir) -> DataFrame:
    found = deeds.deed_boundaries(deeds.parse_deeds(field._deeds(spark, sf_dir)))
    return found.select("doc", "n", r("dx", 4).alias("dx"), r("dy", 4).alias("dy"), r("perimeter", 4).alias("perimeter"), F.size("ring").cast("long").alias("corners"))


@query("deed_rejects", f"WITH {B.LEGS_SQL} SELECT t AS doc, count(*) AS calls, 0::BIGINT AS curves FROM legs WHERE l_partkey % 7 != 0 AND l_partkey % 11 = 0 GROUP BY t")
def deed_rejects(spark, sf_dir) -> DataFrame:
    return deeds.deed_rejects(deeds.parse_deeds(field._deeds(spark, sf_dir)))


@query("training_pairs")
def training_pairs(spark, sf_dir) -> DataFrame:
    docs = field._deeds(spark, sf_dir)
    return deeds.training_pairs(docs, deeds.parse_deeds(docs))


_TRACTS = """WITH docs AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'Tract 1: lot ' || o_custkey || chr(10) || 'TRACT B: lot 2' ELSE 'Lot ' || o_custkey || ', Sec. 5, T3N R2W' END
  || CASE WHEN o_orderkey % 7 < 3 THEN ' save and except the north part' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' Reserving unto the ' || o_orderpriority ELSE '' END AS text FROM orders)"""


def _tracts(spark, sf_dir) -> DataFrame:
    k, lot = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    body = F.when(k % 2 == 0, F.concat(F.lit("Tract 1: lot "), lot, F.lit("\nTRACT B: lot 2"))).otherwise(F.concat(F.lit("Lot "), lot, F.lit(", Sec. 5, T3N R2W")))
    saved = F.when(k % 7 < 3, " save and except the north part").otherwise("")
    reserved = F.when(k % 5 == 0, F.concat(F.lit(" Reserving unto the "), "o_orderpriority")).otherwise("")
    return load(spark, sf_dir, "orders").select(k.alias("doc"), F.concat(body, saved, reserved).alias("text"))


@query("all_tracts", "SELECT o_orderkey AS doc, role, CASE role WHEN 'parent' THEN o_totalprice WHEN 'exception' THEN o_custkey::DOUBLE END AS area FROM orders, (VALUES ('parent'), ('exception'), ('reservation')) v(role) WHERE role = 'parent' OR o_orderkey % CASE role WHEN 'exception' THEN 3 ELSE 5 END = 0")
def all_tracts(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    part = lambda role, area, cond: orders.where(cond).selectExpr("o_orderkey as doc", f"'{role}' as role", *([f"{area} as area"] if area else []))
    return deeds.all_tracts(part("parent", "o_totalprice", "true"), part("exception", "cast(o_custkey as double)", "o_orderkey % 3 = 0"), part("reservation", None, "o_orderkey % 5 = 0"))


@query("deed_flags", f"{_TRACTS} SELECT doc, contains(text, 'T3N') AS is_plss, contains(text, 'save') OR contains(text, 'Reserving') AS has_exception, contains(text, 'Tract') AS is_multi_tract FROM docs")
def deed_flags(spark, sf_dir) -> DataFrame:
    return deeds.deed_flags(_tracts(spark, sf_dir))


_ROLES = f"""{_TRACTS}, parts AS (SELECT doc, trim(unnest(parts), ' ' || chr(10)) AS part FROM (SELECT doc, string_split_regex(regexp_replace(text, '(TRACT B|save|Reserving)', '~\\1', 'g'), '~') AS parts FROM docs)),
roles AS (SELECT doc, part, CASE WHEN part LIKE 'save%' THEN 'exception' WHEN part LIKE 'Reserving%' THEN 'reservation' WHEN part LIKE 'TRACT B%' THEN 'additional' ELSE 'parent' END AS role FROM parts)"""


@query("split_tracts", f"{_ROLES} SELECT doc, role, part FROM roles")
def split_tracts(spark, sf_dir) -> DataFrame:
    return deeds.split_tracts(_tracts(spark, sf_dir)).select("doc", "role", F.trim(F.regexp_replace("part", "\n", " ")).alias("part"))


@query("net_area", f"{_ROLES} SELECT doc, round(greatest(100.0 * max(length(part)) FILTER (role = 'parent') - coalesce(sum(100.0 * length(part)) FILTER (role = 'exception'), 0), 0), 3)::DOUBLE AS net, coalesce(sum(length(part)) FILTER (role = 'exception'), 0) <= max(length(part)) FILTER (role = 'parent') AS exact FROM roles GROUP BY doc")
def net_area(spark, sf_dir) -> DataFrame:
    areas = deeds.split_tracts(_tracts(spark, sf_dir)).withColumn("area", F.lit(100.0) * F.length(F.trim(F.regexp_replace("part", "\n", " "))))
    return deeds.net_area(areas).select("doc", r("net", 3).alias("net"), "exact")


@query("fabric_rings", f"{_P} SELECT id, 5::BIGINT AS points, round((x1 - x0) * (y1 - y0), 3) AS area FROM parcels")
def fabric_rings(spark, sf_dir) -> DataFrame:
    found = fabric.fabric_rings(fabric.fabric_edges(B.parcels(spark, sf_dir), 0.5), 0.5)
    return found.select("id", F.size("ring").cast("long").alias("points"), r(F.abs(rings.signed_area(F.col("ring"))), 3).alias("area"))


@query(
    "presence",
    f"""WITH {B.OPS_SQL}, last AS (SELECT doc, actor, max(ts) AS ts, arg_max(x, ts) AS x, arg_max(y, ts) AS y FROM ops GROUP BY doc, actor)
SELECT doc, actor, ts, x, y FROM (SELECT *, max(ts) OVER (PARTITION BY doc) AS newest FROM last) WHERE ts >= newest - INTERVAL 3 DAY""",
)
def presence(spark, sf_dir) -> DataFrame:
    return editlog.presence(B.ops(load(spark, sf_dir, "events")), "3 days")


# Shared editing: 300 events in a row are the operations on one polygon.

_EDITS = """ops AS (SELECT event_id // 300 AS doc, CASE WHEN event_id % 10 < 6 THEN 'insert' WHEN event_id % 10 < 9 THEN 'move' ELSE 'delete' END AS kind, event_id * 7 % 300 // 2 AS vertex,
  CASE WHEN user_id % 5 > 0 THEN greatest(event_id * 7 % 300 // 2 - 1 - user_id % 3, 0) END AS after, CASE WHEN event_id % 37 > 0 THEN value END AS x, event_id * 0.5::DOUBLE AS y, ts, user_id AS actor FROM events)"""
#: A vertex's place in the ring is the path of stamps from its root; a path comes before those that begin with it.
_RINGS = f"""WITH RECURSIVE {_EDITS},
made AS (SELECT doc, vertex, min(struct_pack(ts := ts, actor := actor)) AS stamp, arg_min(struct_pack(x := x, y := y, after := after), struct_pack(ts := ts, actor := actor, x := x, y := y)) AS m FROM ops WHERE kind = 'insert' AND x IS NOT NULL GROUP BY doc, vertex),
hung AS (SELECT a.doc, a.vertex, a.stamp, a.m, b.vertex AS parent FROM made a LEFT JOIN made b ON b.doc = a.doc AND b.vertex = a.m.after AND b.stamp < a.stamp),
tree AS (SELECT doc, vertex, [struct_pack(s := stamp, v := vertex)] AS path FROM hung WHERE parent IS NULL
  UNION ALL SELECT h.doc, h.vertex, list_append(t.path, struct_pack(s := h.stamp, v := h.vertex)) FROM hung h JOIN tree t ON t.doc = h.doc AND t.vertex = h.parent),
moved AS (SELECT o.doc, o.vertex, arg_max(struct_pack(x := o.x, y := o.y), struct_pack(ts := o.ts, actor := o.actor, x := o.x, y := o.y)) AS at FROM ops o JOIN made m ON m.doc = o.doc AND m.vertex = o.vertex AND struct_pack(ts := o.ts, actor := o.actor) > m.stamp WHERE kind = 'move' AND o.x IS NOT NULL GROUP BY o.doc, o.vertex),
gone AS (SELECT DISTINCT doc, vertex FROM ops WHERE kind = 'delete')
SELECT t.doc, (row_number() OVER (PARTITION BY t.doc ORDER BY path) - 1)::INTEGER AS pos, t.vertex, coalesce(v.at.x, h.m.x) AS x, coalesce(v.at.y, h.m.y) AS y
FROM tree t JOIN hung h USING (doc, vertex) LEFT JOIN moved v USING (doc, vertex) ANTI JOIN gone USING (doc, vertex)"""


def _edits(spark, sf_dir) -> DataFrame:
    kind = "case when event_id % 10 < 6 then 'insert' when event_id % 10 < 9 then 'move' else 'delete' end as kind"
    return load(spark, sf_dir, "events").selectExpr("event_id div 300 as doc", kind, "event_id * 7 % 300 div 2 as vertex", "if(user_id % 5 > 0, greatest(event_id * 7 % 300 div 2 - 1 - user_id % 3, 0), null) as after", "if(event_id % 37 > 0, value, null) as x", "event_id * 0.5D as y", "ts", "user_id as actor")


@query("replay_geometry", _RINGS)
def replay_geometry(spark, sf_dir) -> DataFrame:
    return editlog.replay_geometry(_edits(spark, sf_dir))


@query("stream_geometry", _RINGS)
def stream_geometry(spark, sf_dir) -> DataFrame:
    """The plan of the live feed over the whole table, and the rings of its result."""
    return editlog.ring_order(live.live_geometry(_edits(spark, sf_dir)))


@query(
    "stream_presence",
    f"""WITH {B.OPS_SQL}, s AS (SELECT doc, actor, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS next FROM ops WINDOW w AS (PARTITION BY doc, actor ORDER BY ts))
SELECT doc, actor, 'join' AS event, ts FROM s WHERE before IS NULL OR ts > before + INTERVAL 6 HOUR UNION ALL SELECT doc, actor, 'leave', ts + INTERVAL 6 HOUR FROM s WHERE next IS NULL OR next > ts + INTERVAL 6 HOUR""",
)
def stream_presence(spark, sf_dir) -> DataFrame:
    """Joins and leaves by the batch twin; tests hold the live feed against it."""
    return editlog.presence_events(B.ops(load(spark, sf_dir, "events")), "6 hours").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

"""Queries of field files: events written as lines of each format, and scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.plans.registry import query
from cadastre.sources import field
from cadastre.sources.tables import load
from cadastre.streaming import live

#: What the lines say, as DuckDB reads it from the events: every sixth opens a setup.
_E = """e AS (SELECT user_id AS file, event_id AS i, event_id % 6 = 0 AS opens, event_id * 17 % 360 AS deg, event_id % 60 AS mi, event_id * 7 % 60 AS sec, 80 + event_id % 20 AS zen,
  1000 + event_id % 90000 AS mm, event_id % 4 AS th, 1500 + event_id % 100 AS ih FROM events),
w AS (SELECT *, sum(opens::INT) OVER o AS setup, last_value(CASE WHEN opens THEN i END IGNORE NULLS) OVER o AS station FROM e WINDOW o AS (PARTITION BY file ORDER BY i ROWS UNBOUNDED PRECEDING))"""
#: The same columns in Spark.
_COLUMNS = ("ts", "event_type", "user_id as file", "event_id as line_no", "event_id as i", "event_id % 6 = 0 as opens", "event_id * 17 % 360 as deg", "event_id % 60 as mi", "event_id * 7 % 60 as sec", "80 + event_id % 20 as zen", "1000 + event_id % 90000 as mm", "event_id % 4 as th", "1500 + event_id % 100 as ih")


def _events(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*_COLUMNS)


def _kinds(ha: str, va: str, sd: str, target: str, th: str) -> str:
    parts = [f"SELECT file, i AS line_no, setup::BIGINT AS setup, station, {target} AS target, '{k}' AS kind, round({v}, 6) AS value, {th} AS target_height FROM w WHERE NOT opens AND setup > 0" for k, v in (("HA", ha), ("VA", va), ("SD", sd))]
    return " UNION ALL ".join(parts)


def _lines(spark, sf_dir, setup: str, shot: str, head: str | None = None) -> DataFrame:
    """A line of text for each event, after a header line; ``setup`` and ``shot`` are SQL."""
    events = _events(spark, sf_dir)
    rows = events.select("file", "line_no", F.expr(f"if(opens, {setup}, {shot})").alias("line"))
    return rows if head is None else rows.unionByName(events.selectExpr("file", "-1L as line_no", f"'{head}' as line").distinct())


def _seen(found: field.Field) -> DataFrame:
    o = found.observations
    return o.select("file", "line_no", "setup", F.regexp_replace("occupied", "^P", "").cast("long").alias("station"), F.regexp_replace("target", "^T", "").cast("long").alias("target"), "kind", F.round("value", 6).alias("value"), F.round("target_height", 6).alias("target_height"))


_DMS = "radians(deg + mi / 60.0 + sec / 3600.0)"


def gsi_lines(spark, sf_dir) -> DataFrame:
    packed = "lpad(deg * 10000000 + mi * 100000 + sec * 1000, 16, '0')"
    shot = f"concat('11....+', lpad(i, 8, '0'), ' 21.104+', {packed}, ' 22.104+', lpad(zen * 10000000, 16, '0'), ' 32..06+', lpad(mm, 8, '0'), ' 87..06+', lpad(th * 1000, 8, '0'))"
    return _lines(spark, sf_dir, "concat('11....+', lpad(i, 8, '0'), ' 84..06+', lpad(ih, 8, '0'))", shot)


@query("scan_gsi", f"WITH {_E} {_kinds(_DMS, 'radians(zen)', 'mm / 1000.0', 'i', 'CASE WHEN th > 0 THEN th::DOUBLE END')}")
def scan_gsi(spark, sf_dir) -> DataFrame:
    return _seen(field.scan_gsi(gsi_lines(spark, sf_dir)))


_DOTTED, _DASHED = "format_string('%d.%02d%02d', deg, mi, sec)", "concat_ws('-', deg, mi, sec)"
_US = "* (1200.0::DOUBLE / 3937)"


@query("scan_sdr", f"WITH {_E} {_kinds(_DMS, 'radians(zen)', f'mm / 1000.0 {_US}', 'i', '0.0::DOUBLE')}")
def scan_sdr(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir, f"concat('09P', i, ' B1 ', {_DOTTED})", f"concat('08T', i, '  ', {_DOTTED}, ' ', zen * 10000000, ' ', mm / 1000)", "00NMSDR33 V04-01 2")
    return _seen(field.scan_sdr(rows))


@query("scan_nikon", f"WITH {_E} {_kinds(_DMS, 'radians(zen)', 'mm / 1000.0 * 0.3048::DOUBLE', 'i', 'round(th * 0.3048, 6)::DOUBLE')}")
def scan_nikon(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir, f"concat('ST, P', i, ',B1,', ih / 1000, ',', {_DASHED})", f"concat('ss,T', i, ',', {_DASHED}, ',', zen, ',', mm / 1000, ',', th)", "JE,JOB,3")
    return _seen(field.scan_nikon(rows))


@query("scan_rw5", f"WITH {_E} {_kinds(_DMS, 'radians(zen)', 'mm / 1000.0', 'i', '5.5::DOUBLE')}")
def scan_rw5(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir, "concat('OC,OPP', i, ',HI', ih / 1000)", f"concat('SS,OPx,FPT', i, ',AZ', {_DOTTED}, ',ZE', zen, ',SD', mm / 1000, ',--CODE')", "LS,HI5.250,HR5.500")
    return _seen(field.scan_rw5(rows))


_SETUPS = "SELECT file, setup::BIGINT AS setup, i AS station, round(ih / 1000.0, 6)::DOUBLE AS instrument_height, 'B' || i AS backsight, round({az}, 6) AS backsight_az FROM w WHERE opens"


#: Observations before any setup belong to the file's first one, if it has any.
_JXL = " UNION ALL ".join(
    f"""SELECT file, i AS line_no, greatest(setup, 1)::BIGINT AS setup, coalesce(station, first) AS station, i AS target, '{k}' AS kind, round({v}, 6) AS value, th::DOUBLE AS target_height
FROM (SELECT *, min(CASE WHEN opens THEN i END) OVER (PARTITION BY file) AS first FROM w) WHERE NOT opens AND first IS NOT NULL"""
    for k, v in (("HA", "radians(deg)"), ("VA", "radians(zen)"), ("SD", "mm / 1000.0"))
)


@query("scan_jxl", f"WITH {_E} {_JXL}")
def scan_jxl(spark, sf_dir) -> DataFrame:
    own = "coalesce(last(if(opens, i, null), true) over (partition by file order by i), -1)"
    setup = "concat('<StationSetup><ID>', i, '</ID><StationName>P', i, '</StationName><TheodoliteHeight>', ih / 1000, '</TheodoliteHeight></StationSetup>')"
    shot = f"concat('<RegularObservation><StationID>', {own}, '</StationID><TargetID>T', i, '</TargetID><HorizontalCircle>', deg, '</HorizontalCircle><VerticalCircle>', zen, '</VerticalCircle><SlopeDistance>', mm / 1000, '</SlopeDistance><HorizontalDistance>1</HorizontalDistance><TargetHeight>', th, '</TargetHeight></RegularObservation>')"
    return _seen(field.scan_jxl(_lines(spark, sf_dir, setup, shot)))


@query("field_setups", f"WITH {_E} {_SETUPS.format(az='radians(deg + mi / 60.0 + sec / 3600.0)')}")
def field_setups(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir, f"concat('ST,P', i, ',B', i, ',', ih / 1000, ',', {_DASHED})", "concat('SS,T', i, ',1,2,3,4')")
    s = field.FORMATS["nikon"](rows).setups
    return s.select("file", "setup", F.regexp_replace("occupied", "^P", "").cast("long").alias("station"), F.round("instrument_height", 6).alias("instrument_height"), "backsight", F.round("backsight_az", 6).alias("backsight_az"))


@query("field_warnings", f"WITH {_E} SELECT file, i AS line_no, 'observation before any setup' AS warning FROM w WHERE NOT opens AND setup = 0")
def field_warnings(spark, sf_dir) -> DataFrame:
    return field.scan_gsi(gsi_lines(spark, sf_dir)).warnings


@query("scan_lines", "SELECT doc_id AS file, line_no, length(line) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)")
def scan_lines(spark, sf_dir) -> DataFrame:
    return field.lines_of(load(spark, sf_dir, "documents"), "doc_id").select("file", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("size"))


@query("scan_pnezd", "SELECT user_id AS file, event_id AS point, (event_id * 3 % 7000)::DOUBLE AS y, event_id % 5000 + 0.5::DOUBLE AS x, (event_id % 90 - 20)::DOUBLE AS z, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS code FROM events WHERE event_id % 10 <> 9")
def scan_pnezd(spark, sf_dir) -> DataFrame:
    line = "if(i % 10 = 9, concat('# point ', i), concat(' ', i, ',', i * 3 % 7000, ' , ', i % 5000 + 0.5, '  ', i % 90 - 20, if(i % 3 = 0, '', concat(' , ', event_type, ' '))))"
    return field.scan_pnezd(_events(spark, sf_dir).selectExpr("file", "line_no", f"{line} as line")).select("file", "point", "x", "y", "z", "code")


def _nmea(events: DataFrame) -> DataFrame:
    lat, lon = "format_string('%02d%07.4f', i % 80, cast(i * 7 % 60 + 0.25 as double)), if(i % 2 = 0, ',N,', ',S,')", "format_string('%03d%07.4f', i % 180, cast(i * 11 % 60 + 0.5 as double)), if(i % 3 = 0, ',E,', ',W,')"
    gga = f"concat('$GPGGA,120000,', {lat}, {lon}, i % 3, ',08,0.9,', i % 500 / 10, ',M,46.9,M,,*47')"
    return events.selectExpr("ts", "file", "line_no", f"if(i % 7 = 0, '$GPRMC,120000,A', {gga}) as line")


_NMEA = """SELECT {ts} user_id AS file, event_id AS line_no, round(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 80 + (event_id * 7 % 60 + 0.25::DOUBLE) / 60), 7) + 0.0 AS lat,
 round(CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END * (event_id % 180 + (event_id * 11 % 60 + 0.5::DOUBLE) / 60), 7) + 0.0 AS lon, (event_id % 500 / 10)::DOUBLE AS alt FROM events WHERE event_id % 7 <> 0 AND event_id % 3 > 0"""


@query("scan_nmea", _NMEA.format(ts=""))
def scan_nmea(spark, sf_dir) -> DataFrame:
    got = field.scan_nmea(_nmea(_events(spark, sf_dir)))
    return got.select("file", "line_no", (F.round("lat", 7) + 0.0).alias("lat"), (F.round("lon", 7) + 0.0).alias("lon"), "alt")


@query("stream_fixes", f"SELECT file, count(*) AS n, round(max(alt), 6) AS alt FROM ({_NMEA.format(ts='ts,')}) GROUP BY file")
def stream_fixes(spark, sf_dir) -> DataFrame:
    fixes = live.stream_fixes(_nmea(_events(spark, sf_dir)))
    return fixes.groupBy("file").agg(F.count("*").alias("n"), F.round(F.max("alt"), 6).alias("alt"))


@query("scan_rinex_header", "SELECT c_custkey AS file, 'M' || c_custkey AS marker, 'TYPE ' || c_nationkey AS receiver, round(c_acctbal, 2)::DOUBLE AS x, -(c_custkey % 1000)::DOUBLE AS y, 4000000.5::DOUBLE AS z FROM customer WHERE c_custkey % 9 > 0")
def scan_rinex_header(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    label = lambda value, name: F.concat(F.rpad(value, 60, " "), F.lit(name))
    xyz = F.concat(F.lpad(F.round("c_acctbal", 2).cast("string"), 14, " "), F.lpad((-(k % 1000)).cast("string"), 14, " "), F.lpad(F.lit("4000000.5"), 14, " "))
    head = [
        label(F.lit("     3.04"), "RINEX VERSION / TYPE"), F.when(k % 9 == 0, F.lit("")).otherwise(label(F.concat(F.lit("M"), k), "MARKER NAME")),
        label(F.concat(F.rpad(F.lit("123"), 20, " "), F.lit("TYPE "), F.col("c_nationkey")), "REC # / TYPE / VERS"), label(xyz, "APPROX POSITION XYZ"), label(F.lit(""), "END OF HEADER"), label(F.lit("OTHER"), "MARKER NAME"),
    ]
    files = load(spark, sf_dir, "customer").select(k.alias("file"), F.concat_ws("\n", *head).alias("text"))
    return field.scan_rinex_header(field.lines_of(files)).select("file", "marker", "receiver", "x", "y", "z")


_HEADS = (("gsi", "11....+00000001"), ("sdr", "00NMSDR33"), ("raw", "ST,P1"), ("rw5", "JB,NM"), ("jxl", "<JOBFile>"), ("obs", " 3.04 RINEX VERSION"), ("log", "$GPGGA,1"), ("json", '{"type": "FeatureCollection"}'), ("landxml", "<LandXML>"), ("xyz", "1 2 3"), ("pdf", "%PDF"))
_ROUTED = ("gsi", "sdr", "nikon", "rw5", "jxl", "rinex", "nmea", "geojson", "landxml", "xyz", None)


@query("route_files", "SELECT 'f' || o_orderkey || '.' || ['gsi', 'sdr', 'raw', 'rw5', 'jxl', 'obs', 'log', 'json', 'landxml', 'xyz', 'pdf'][1 + o_orderkey % 11] AS file, ['gsi', 'sdr', 'nikon', 'rw5', 'jxl', 'rinex', 'nmea', 'geojson', 'landxml', 'xyz', NULL][1 + o_orderkey % 11] AS format FROM orders")
def route_files(spark, sf_dir) -> DataFrame:
    n = (F.col("o_orderkey") % 11).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(h[i]) for h in _HEADS]), n)
    files = load(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey"), F.lit("."), pick(0)).alias("file"), pick(1).alias("head"))
    return field.route_files(files).select("file", "format")


@query("scan_xyz", "WITH p AS (SELECT user_id AS file, event_id AS line_no, (event_id * 13 % 40000 + CASE WHEN user_id % 3 = 0 THEN 60000 ELSE 0 END)::DOUBLE AS x, (event_id % 777)::DOUBLE AS y, (event_id % CASE WHEN user_id % 3 = 1 THEN 90 ELSE 300 END)::DOUBLE AS z FROM events WHERE event_id % 5 > 0), a AS (SELECT file, arg_min(greatest(abs(x), abs(y)), line_no) AS reach, max(abs(z)) AS height FROM p GROUP BY file) SELECT file, line_no, x, y, round(z * CASE WHEN reach > 50000 OR height > 100 THEN 0.3048 ELSE 1 END, 6)::DOUBLE AS z FROM p JOIN a USING (file)")
def scan_xyz(spark, sf_dir) -> DataFrame:
    line = "if(i % 5 = 0, concat('# ', i), concat_ws(' ', i * 13 % 40000 + if(file % 3 = 0, 60000, 0), i % 777, concat(i % if(file % 3 = 1, 90, 300), '  ; note')))"
    return field.scan_xyz(_events(spark, sf_dir).selectExpr("file", "line_no", f"{line} as line")).select("file", "line_no", "x", "y", F.round("z", 6).alias("z"))
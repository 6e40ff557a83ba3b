"""Queries that write surveys as LandXML and read the files back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions import rings
from cadastre.plans import bindings as B
from cadastre.plans.registry import query
from cadastre.sources import landxml
from cadastre.sources.tables import fresh_path

WHEN = dt.datetime(2024, 5, 1, 12, 0, 0)
_HEAD = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2" language="en" date="2024-05-01" time="12:00:00">' || chr(10) || ' <Units><Metric areaUnit="squareMeter" linearUnit="meter" volumeUnit="cubicMeter" temperatureUnit="celsius" pressureUnit="milliBars" angularUnit="decimal degrees" directionUnit="decimal degrees"/></Units>' || chr(10) || ' <CoordinateSystem epsgCode="32614" name="EPSG:32614"/>'"""


def _parcels(spark, sf_dir) -> DataFrame:
    """A survey has a twentieth of the parcels."""
    return B.parcels(spark, sf_dir).select((F.col("id") % 20).alias("survey"), F.col("id").alias("parcel"), F.concat(F.lit("Lot <"), F.col("id").cast("string"), F.lit(">")).alias("name"), "ring")


def _faces(spark, sf_dir) -> DataFrame:
    """Two triangles for each parcel, on three surfaces a survey."""
    point = lambda i: F.struct(F.col("ring")[i]["x"].alias("x"), F.col("ring")[i]["y"].alias("y"), (F.col("id") % 100).cast("double").alias("z"))
    halves = F.explode(F.array(*[F.array(point(a), point(b), point(c)) for a, b, c in ((0, 1, 2), (0, 2, 3))]))
    return B.parcels(spark, sf_dir).select((F.col("id") % 20).alias("survey"), F.concat(F.lit("S"), F.col("id") % 3).alias("surface"), halves.alias("ring"))


@query(
    "to_landxml",
    f"""WITH {B.PARCELS_SQL}, c AS (SELECT id % 20 AS survey, id AS parcel, seq, CASE WHEN seq IN (0, 3) THEN x0 ELSE x1 END AS ax, CASE WHEN seq IN (0, 1) THEN y0 ELSE y1 END AS ay, CASE WHEN seq IN (0, 1) THEN x1 ELSE x0 END AS ex, CASE WHEN seq IN (1, 2) THEN y1 ELSE y0 END AS ey FROM parcels, (VALUES (0), (1), (2), (3)) s(seq)),
t AS (SELECT *, printf('%.6f %.6f', ay, ax) AS a, printf('%.6f %.6f', ey, ex) AS b FROM c),
p AS (SELECT survey, a, row_number() OVER (PARTITION BY survey ORDER BY min((parcel, seq))) AS k FROM t GROUP BY survey, a),
s AS (SELECT DISTINCT id % 20 AS survey FROM parcels)
SELECT survey, section, -1::BIGINT AS parcel, -1::INTEGER AS part, -1::BIGINT AS k, value FROM s, (VALUES (0, {_HEAD}), (1, ' <CgPoints name="points">'), (3, ' </CgPoints>'), (5, ' <Parcels>'), (7, ' </Parcels>' || chr(10) || '</LandXML>')) v(section, value)
UNION ALL SELECT survey, 2, -1, -1, k, '  <CgPoint name="P' || k || '">' || a || ' 0.000000</CgPoint>' FROM p
UNION ALL SELECT id % 20, 6, id, 0, -1, '  <Parcel name="Lot &lt;' || id || '&gt;"><CoordGeom>' FROM parcels UNION ALL SELECT id % 20, 6, id, 2, -1, '  </CoordGeom></Parcel>' FROM parcels
UNION ALL SELECT survey, 6, parcel, 1, seq, '   <Line><Start>' || a || '</Start><End>' || b || '</End></Line>' FROM t""",
)
def to_landxml(spark, sf_dir) -> DataFrame:
    return landxml.landxml_lines(_parcels(spark, sf_dir), epsg=32614, when=WHEN).select("survey", "section", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("parcel", "part", "k")], "value")


def _read_back(spark, sf_dir) -> landxml.LandXML:
    path = fresh_path(spark, "landxml")
    landxml.write_landxml(path, _parcels(spark, sf_dir), _faces(spark, sf_dir), 32614, WHEN, "gzip")
    return landxml.read_landxml(spark, path)


def _survey() -> Column:
    return F.regexp_extract("file", r"survey=(\d+)/", 1).cast("long").alias("survey")


@query("scan_landxml", f"WITH {B.PARCELS_SQL} SELECT id % 20 AS survey, 'Lot <' || id || '>' AS name, 32614::INTEGER AS epsg, 5::INTEGER AS corners, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM parcels")
def scan_landxml(spark, sf_dir) -> DataFrame:
    """The files written by write_landxml(), read by read_landxml()."""
    x0, y0, x1, y1 = rings.bounds(F.col("ring"))
    return _read_back(spark, sf_dir).parcels.select(_survey(), "name", "epsg", F.size("ring").alias("corners"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.round(rings.signed_area(F.col("ring")), 6).alias("area"))


@query(
    "scan_landxml_faces",
    f"WITH {B.PARCELS_SQL} SELECT DISTINCT id % 20 AS survey, 'S' || id % 3 AS surface, (id % 100)::DOUBLE AS z, x0, y0, x1 AS b_x, CASE WHEN half = 0 THEN y0 ELSE y1 END AS b_y, CASE WHEN half = 0 THEN x1 ELSE x0 END AS c_x, y1 AS c_y FROM parcels, (VALUES (0), (1)) h(half)",
)
def scan_landxml_faces(spark, sf_dir) -> DataFrame:
    a, b, c = (F.col("ring")[i] for i in range(3))
    return _read_back(spark, sf_dir).faces.select(_survey(), "surface", a["z"].alias("z"), a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("b_x"), b["y"].alias("b_y"), c["x"].alias("c_x"), c["y"].alias("c_y"))

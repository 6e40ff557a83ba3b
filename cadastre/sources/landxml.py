"""LandXML files: parcels and surface triangles read by Spark's XML reader, and surveys written as one file each."""

from __future__ import annotations

import datetime as dt
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastre.functions import rings

_PARCEL = "_name string, _area string, Description string, CoordGeom array<struct<Line:array<struct<Start:string,End:string>>>>"
_SURFACE = "_name string, Definition string"
_SURFACE_ARRAYS = "_name string, Definition struct<Pnts:array<struct<P:array<struct<_VALUE:string,_id:string>>>>,Faces:array<struct<F:array<struct<_VALUE:string,_id:string>>>>>"
_FACES = "file string, surface string, face int, ring array<struct<x:double,y:double,z:double>>"
#: Elements outside of a surface's Definition, whose escapes don't matter to it.
OUTSIDE = ("Parcel", "Surface", "Description", "Project", "Application", "Author", "CgPoint", "CoordinateSystem", "LandXML")
#: Faces that are returned at once.
CHUNK = 1 << 15


class LandXML(NamedTuple):
    """parcels(file, name, description, area, epsg, ring), faces(file, surface, face, ring with z)."""

    parcels: DataFrame
    faces: DataFrame


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).schema(schema)
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), "*")


def _parts(text: Column) -> Column:
    """The numbers of a text, null for what is none."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda v: v.try_cast("double"))


def _place(text: Column) -> Column:
    """struct<x, y> of northing and easting, null without both."""

    def of(v: Column) -> Column:
        n, e = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        return F.when(n.isNotNull() & e.isNotNull(), F.struct(e.alias("x"), n.alias("y")))

    return rings.let(_parts(text), of)


def _escaped_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the files with an escape, CDATA or an apostrophe in other elements than those of OUTSIDE; a row of the reading is a tag and the text after it."""
    tags = spark.read.option("recursiveFileLookup", True).option("lineSep", "<").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    signs = F.col("value").contains("&") | F.col("value").contains("'") | F.col("value").startswith("![CDATA[")
    return tags.where(signs).where(~F.col("value").rlike(rf"^(/?({'|'.join(OUTSIDE)})[\s>/]|\?|!--)")).select("file").distinct()


def _number(text: str) -> float | None:
    """A text as Spark's try_cast to double has it."""
    try:
        return float(text) if "_" not in text else None
    except ValueError:
        return float(text[:-1]) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]", text, re.ASCII) else None


def _definition(text: str) -> tuple[dict[str, int], array, list[tuple[int, str]]]:
    """(rows, places, faces) of a Definition's text: the row of each point's id, x, y, z of the rows, and number and text of the faces."""
    rows, places, faces, path, held = {}, array("d"), [], [], []
    seen, own = 0, None

    def begin(name: str, attributes: dict[str, str]) -> None:
        nonlocal own
        path.append(name)
        held.clear()
        if len(path) == 3:
            own = attributes["id"].strip(" \t\r\n") if "id" in attributes else None

    def end(name: str) -> None:
        nonlocal seen
        if len(path) == 3 and name == "P" and path[1] == "Pnts":
            place = [_number(v) for v in "".join(held).split()[:3]] if own is not None else []
            if len(place) == 3 and None not in place:
                rows[own] = len(places) // 3
                places.extend((place[1], place[0], place[2]))
        elif len(path) == 3 and name == "F" and path[1] == "Faces":
            faces.append((seen, "".join(held)))
            seen += 1
        path.pop()

    parser = expat.ParserCreate()
    parser.buffer_text, parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = True, begin, end, held.append
    for part in ("<Definition>", text, "</Definition>"):
        parser.Parse(part, part == "</Definition>")
    return rows, places, faces


def _faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, surface, Definition) to (file, surface, face, ring)."""
    for batch in batches:
        for k in range(batch.num_rows):
            file, surface, text = (column[k].as_py() for column in batch.columns)
            rows, places, faces = _definition(text)
            at = np.asarray(places).reshape(-1, 3)
            for low in range(0, len(faces), CHUNK):
                found = [(n, [rows[id] for id in ids.split() if id in rows]) for n, ids in faces[low : low + CHUNK]]
                found = [(n, ring + ring[:1]) for n, ring in found if len(ring) >= 3]
                corners = at[np.array([i for _, ring in found for i in ring], dtype=np.int64)]
                points = pa.StructArray.from_arrays([pa.array(corners[:, c]) for c in range(3)], names=["x", "y", "z"])
                ends = np.cumsum([0] + [len(ring) for _, ring in found], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(found)), pa.repeat(pa.scalar(surface, pa.string()), len(found)), pa.array([n for n, _ in found], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), points)], names=["file", "surface", "face", "ring"])


def _faces_of_arrays(elements: DataFrame) -> DataFrame:
    """(file, surface, face, ring) of elements of _SURFACE_ARRAYS: points and faces meet as rows."""
    flat = lambda outer, inner: F.flatten(F.transform(F.coalesce(F.col(f"Definition.{outer}"), F.array()), lambda g: F.coalesce(g[inner], F.array())))
    surfaces = elements.select("file", F.col("_name").alias("surface"), flat("Pnts", "P").alias("points"), flat("Faces", "F").alias("faces"))
    # Points and faces come from one reading; a window over a point's id brings both together.
    surfaces = surfaces.withColumn("own", F.monotonically_increasing_id())  # tells apart surfaces of one name in a file
    rows = surfaces.select("file", "surface", "own", F.size("points").alias("n"), F.posexplode(F.concat("points", "faces")).alias("at", "e"))
    rows = rows.select("file", "surface", "own", F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.col("at") - F.col("n")).alias("at"), F.col("e._id").alias("id"), F.col("e._VALUE").alias("text"), (F.col("at") >= F.col("n")).alias("face"))
    whole = lambda v: (F.size(v) >= 3) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull()
    place = rings.let(_parts(F.col("text")), lambda v: F.when(whole(v), F.struct(v[1].alias("x"), v[0].alias("y"), v[2].alias("z"))))
    none = F.lit(None).cast("struct<x:double,y:double,z:double>")
    corner = lambda seq, id, p: F.struct(seq.cast("int").alias("seq"), id.alias("id"), p.alias("p"))
    ids = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    corners = F.when(F.col("face"), F.transform(ids, lambda id, seq: corner(seq, id, none))).otherwise(F.filter(F.array(corner(F.lit(None), F.col("id"), place)), lambda c: c["id"].isNotNull() & c["p"].isNotNull()))
    rows = rows.select("file", "surface", "own", "at", "face", F.explode(corners).alias("c")).select("file", "surface", "own", "at", "face", "c.*")
    last = F.max(F.when(~F.col("face"), F.struct("at", "p"))).over(Window.partitionBy("own", "id"))
    found = rows.withColumn("last", last).where("face and last is not null").groupBy("file", "surface", "own", F.col("at").alias("face"))
    found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("last.p").alias("p")))), lambda c: c["p"]).alias("ring"))
    return found.where("size(ring) >= 3").select("file", "surface", "face", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))


def read_landxml(spark: SparkSession, path: str, epsg: int | None = None) -> LandXML:
    """All LandXML files under a path; element names without a prefix.

    A parcel's ring takes the starts of its lines and the end of the last one,
    is closed and made counter-clockwise; other segments than lines are passed
    over, and parcels of fewer than three corners left out.  ``epsg`` is that
    of files that don't name one.  A face is the ring of the points that it
    names and its surface has, in that order, left out below three; of points
    with one id the last counts, numbers count from 0 over the surface.
    A parcel's or a surface's element is read in one row.  Spark's reader copies
    an array for each element that it adds, so a surface is read as text and its
    points and faces meet in its task; only files with escapes in their surfaces, which
    that text has lost, are read as arrays.
    """
    system = _elements(spark, path, "CoordinateSystem", "_epsgCode int").groupBy("file").agg(F.min("_epsgCode").alias("epsg"))
    lines = F.flatten(F.transform("CoordGeom", lambda g: F.coalesce(g["Line"], F.array())))
    read = _elements(spark, path, "Parcel", _PARCEL).where("CoordGeom is not null").withColumn("lines", lines)
    corners = F.concat(F.transform("lines", lambda e: _place(e["Start"])), F.transform(F.slice(F.reverse("lines"), 1, 1), lambda e: _place(e["End"])))
    read = read.withColumn("ring", rings.closed(F.filter(corners, lambda p: p.isNotNull()))).where("size(ring) >= 4")
    parcels = read.join(system, "file", "left").select("file", F.col("_name").alias("name"), F.col("Description").alias("description"), F.col("_area").try_cast("double").alias("area"), F.coalesce("epsg", F.lit(epsg).cast("int")).alias("epsg"), rings.oriented(F.col("ring")).alias("ring"))

    surfaces = _elements(spark, path, "Surface", _SURFACE).where("Definition is not null").select("file", F.col("_name").alias("surface"), "Definition")
    odd = [r.file for r in _escaped_surfaces(spark, path).collect()]
    faces = surfaces.where(~F.col("file").isin(odd)).mapInArrow(_faces, _FACES)
    if odd:
        faces = faces.unionByName(_faces_of_arrays(_elements(spark, path, "Surface", _SURFACE_ARRAYS).where(F.col("file").isin(odd))))
    return LandXML(parcels, faces)


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def landxml_lines(parcels: DataFrame, faces: DataFrame | None = None, epsg: int | None = None, when: dt.datetime | None = None) -> DataFrame:
    """(survey, section, surface, parcel, part, k, value): the lines of a LandXML document of each survey, to be ordered by the columns before ``value``.

    parcels(survey, parcel, name, ring) and perhaps area and description;
    faces(survey, surface, ring of x, y, z), a triangle each.  Corners of
    parcels that agree to six decimals are one point, numbered in the order of
    their first use; parcels without a ring are left out.  A surface's points
    are numbered by x, y and z; faces come in the order of their points, repeated
    ones once, those with a null coordinate never.  Surveys without parcels have
    a document if they have faces.  Points of one survey or surface are
    numbered in one task, row by row from a sort that spills.
    """
    when = when or dt.datetime.now(dt.timezone.utc)
    order = {"section": "int", "surface": "string", "parcel": parcels.schema["parcel"].dataType, "part": "int", "k": "long"}

    def line(value: Column, **at: Column) -> Column:
        return F.struct(*[at.get(c, F.lit(None)).cast(t).alias(c) for c, t in order.items()], value.alias("value"))

    def lines(rows: DataFrame, *arrays: Column) -> DataFrame:
        return rows.select("survey", F.explode(F.concat(*arrays)).alias("line")).select("survey", "line.*")

    rows = parcels.where("ring is not null").withColumn("ring", rings.closed(F.col("ring")))
    optional = {c: F.col(c).cast("string") if c in parcels.columns else F.lit(None).cast("string") for c in ("area", "description")}
    rows = rows.select("survey", "parcel", F.col("name").cast("string").alias("name"), "ring", *[v.alias(c) for c, v in optional.items()])
    northing = lambda p: F.format_string("%.6f %.6f", p["y"], p["x"])
    # A closed ring's last corner is its first.
    places = rows.select("survey", "parcel", F.posexplode(F.slice("ring", F.lit(1), F.greatest(F.size("ring") - 1, F.lit(0)))).alias("seq", "p"))
    points = places.select("survey", F.struct("parcel", "seq").alias("first"), northing(F.col("p")).alias("place")).groupBy("survey", "place").agg(F.min("first").alias("first"))
    numbered = points.withColumn("k", F.row_number().over(Window.partitionBy("survey").orderBy("first")))
    point = F.concat(F.lit('  <CgPoint name="P'), F.col("k").cast("string"), F.lit('">'), F.col("place"), F.lit(" 0.000000</CgPoint>"))

    attribute = lambda name, column: F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(F.col(column)), F.lit('"')), F.lit(""))
    told = F.coalesce(F.concat(F.lit("<Description>"), _escaped(F.col("description")), F.lit("</Description>")), F.lit(""))
    opens = F.concat(F.lit("  <Parcel"), attribute("name", "name"), attribute("area", "area"), F.lit(">"), told, F.lit("<CoordGeom>"))
    side = lambda e: F.concat(F.lit("   <Line><Start>"), northing(e["a"]), F.lit("</Start><End>"), northing(e["b"]), F.lit("</End></Line>"))
    own = {"section": F.lit(6), "parcel": F.col("parcel")}
    sides = F.transform(rings.edges(F.col("ring")), lambda e, seq: line(side(e), **own, part=F.lit(1), k=seq))
    surveys = parcels.select("survey")
    body = [
        lines(numbered, F.array(line(point, section=F.lit(2), k=F.col("k")))),
        lines(rows, F.array(line(opens, **own, part=F.lit(0))), sides, F.array(line(F.lit("  </CoordGeom></Parcel>"), **own, part=F.lit(2)))),
    ]
    if faces is not None:
        surveys = surveys.unionByName(faces.select("survey"))
        body += _surface_lines(faces, line, lines)
    system = f'\n <CoordinateSystem epsgCode="{int(epsg)}" name="EPSG:{int(epsg)}"/>' if epsg is not None else ""
    units = '<Units><Metric areaUnit="squareMeter" linearUnit="meter" volumeUnit="cubicMeter" temperatureUnit="celsius" pressureUnit="milliBars" angularUnit="decimal degrees" directionUnit="decimal degrees"/></Units>'
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2" language="en" date="{when:%Y-%m-%d}" time="{when:%H:%M:%S}">\n {units}{system}'
    frame = {0: head, 1: ' <CgPoints name="points">', 3: " </CgPoints>" + ("\n <Surfaces>" if faces is not None else ""), 5: ("</Surfaces>\n " if faces is not None else " ") + "<Parcels>", 7: " </Parcels>\n</LandXML>"}
    whole = lines(surveys.distinct(), F.array(*[line(F.lit(text), section=F.lit(section)) for section, text in frame.items()]))
    for more in body:
        whole = whole.unionByName(more)
    return whole


def _surface_lines(faces: DataFrame, line, lines) -> list[DataFrame]:
    """Points and faces of surfaces, faces as three point numbers; a point's number is its rank among the corners."""
    known = F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull()) & (F.size("ring") >= 3)
    own = faces.where(known).select("survey", F.col("surface").cast("string").alias("surface"), F.struct(*[F.col(f"ring")[i][c].alias(f"{c}{i}") for i in range(3) for c in "xyz"]).alias("face")).distinct()
    corners = own.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"face.{c}{i}").alias(c) for c in "xyz"]) for i in range(3)])).alias("p")).select("survey", "surface", "face", "p.*")
    of = ["survey", "surface"]
    by = Window.partitionBy(*of).orderBy("x", "y", "z")
    ranked = corners.withColumns({"k": F.dense_rank().over(by), "before": F.lag(F.struct("x", "y", "z")).over(by)})
    points = ranked.where("before is null or before != struct(x, y, z)")
    named = ranked.groupBy(*of, "face").agg(*[F.max(F.when(F.col("i") == i, F.col("k"))).alias(f"k{i}") for i in range(3)])
    value = F.concat(F.lit("   <F>"), F.concat_ws(" ", *[F.col(f"k{i}").cast("string") for i in range(3)]), F.lit("</F>"))
    name = F.col("surface")
    at = {"section": F.lit(4), "surface": name}
    opens = F.concat(F.lit('  <Surface name="'), _escaped(F.coalesce(name, F.lit(""))), F.lit('"><Definition surfType="TIN"><Pnts>'))
    point = F.concat(F.lit('   <P id="'), F.col("k").cast("string"), F.lit('">'), F.format_string("%.6f %.6f %.6f", "y", "x", "z"), F.lit("</P>"))
    frame = F.array(line(opens, **at, part=F.lit(0)), line(F.lit("  </Pnts><Faces>"), **at, part=F.lit(2)), line(F.lit("  </Faces></Definition></Surface>"), **at, part=F.lit(4)))
    return [
        lines(points, F.array(line(point, **at, part=F.lit(1), k=F.col("k"))), F.when(F.col("k") == 1, frame).otherwise(F.slice(frame, 1, 0))),
        lines(named, F.array(line(value, **at, part=F.lit(3), k=F.col("k0")))),
    ]


def write_landxml(path: str, parcels: DataFrame, faces: DataFrame | None = None, epsg: int | None = None, when: dt.datetime | None = None, compression: str | None = None) -> None:
    """One file for each survey, in folders ``survey=..`` of a new path; see landxml_lines() for the columns.

    A survey's lines are sorted in one task, on disk if need be, and written
    one by one: no document is ever held in memory.  ``compression`` (gzip)
    packs the files; read_landxml() reads packed ones too.
    """
    lines = landxml_lines(parcels, faces, epsg, when)
    order = ["section", "surface", "parcel", "part", "k"]
    lines.repartition("survey").sortWithinPartitions("survey", *order, "value").select("survey", "value").write.partitionBy("survey").text(path, compression=compression)

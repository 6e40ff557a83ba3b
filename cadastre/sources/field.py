"""Field files as tables: lines of text to setups, observations and warnings, one plan for all files of a format.

A line's meaning depends on the lines before it (units, heights, the open
setup), so every scan is a projection of the line followed by windows over
(file, line_no).  Angles come out in radians, lengths in metres.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

US_FOOT, FOOT = 1200 / 3937, 0.3048
KINDS = ("HA", "VA", "SD", "HD", "DZ")


class Field(NamedTuple):
    """setups(file, setup, occupied, instrument_height, backsight, backsight_az), observations(file, line_no, setup,
    occupied, target, kind, value, target_height), warnings(file, line_no, warning)."""

    setups: DataFrame
    observations: DataFrame
    warnings: DataFrame


def lines_of(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line_no, line) of whole texts, lines numbered from 1; a null text has none."""
    rows = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.select("file", (F.col("at") + 1).alias("line_no"), F.rtrim("line", F.lit("\r")).alias("line"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files."""
    return lines_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _dotted(text: Column) -> Column:
    """Degrees of DDD.MMSSsss; without a point, whole degrees."""
    minutes, rest = F.regexp_extract(text, r"\.(\d\d)", 1), F.regexp_extract(text, r"\.\d\d(\d+)", 1)
    seconds = F.when(rest == "", 0.0).otherwise(F.concat(F.lit("0."), rest).try_cast("double") * 100)
    return F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("double") + F.when(minutes == "", 0.0).otherwise(minutes.try_cast("double")) / 60 + seconds / 3600


def _packed(number: Column) -> Column:
    """Degrees of the whole number DDDMMSSsss (milliseconds of arc last)."""
    return F.floor(number / 10_000_000) + F.pmod(F.floor(number / 100_000), F.lit(100)) / 60 + F.pmod(number, F.lit(100_000)) / 3_600_000


def _angle(text: Column) -> Column:
    """Radians of D-M-S, DDD.MMSSsss or whole degrees."""
    part = F.split(text, "-")
    dashed = _number(part[0]) + F.coalesce(_number(F.get(part, F.lit(1))), F.lit(0.0)) / 60 + F.coalesce(_number(F.get(part, F.lit(2))), F.lit(0.0)) / 3600
    return F.radians(F.when(text.contains("-"), dashed).otherwise(_dotted(text)))


def _upto(order: str = "line_no") -> Window:
    return Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(_upto())


def _field(rows: DataFrame) -> Field:
    """rows(file, line_no, opens, shot, occupied, backsight, backsight_az, instrument_height, target_height, target, HA..DZ).

    A row that opens a setup starts the next one; a backsight given later in it
    replaces its own.  Heights must be carried already.
    """
    rows = rows.withColumn("setup", F.sum(F.col("opens").cast("long")).over(_upto())).withColumn("at", _last(F.when(F.col("opens"), F.col("occupied"))))
    back = F.max_by(F.struct("backsight", "backsight_az"), F.when(F.col("backsight_az").isNotNull() | F.col("opens"), F.col("line_no")))
    own = rows.where("setup > 0").groupBy("file", "setup").agg(
        F.max(F.when(F.col("opens"), F.col("occupied"))).alias("occupied"), F.max(F.when(F.col("opens"), F.col("instrument_height"))).alias("instrument_height"), back.alias("b")
    )
    setups = own.select("file", "setup", "occupied", "instrument_height", "b.backsight", "b.backsight_az")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])).alias("o")
    seen = rows.where("shot and setup > 0").select("file", "line_no", "setup", F.col("at").alias("occupied"), "target", kinds, "target_height")
    observations = seen.where("o.value is not null").select("file", "line_no", "setup", "occupied", "target", "o.kind", "o.value", "target_height")
    warnings = rows.where("shot and coalesce(setup, 0) = 0").select("file", "line_no", F.lit("observation before any setup").alias("warning"))
    return Field(setups, observations, warnings)


def _rows(lines: DataFrame, **columns: Column) -> DataFrame:
    """The columns that _field needs, null where the format has none."""
    double = {"backsight_az", "instrument_height", "target_height", *KINDS}
    names = ("opens", "shot", "occupied", "backsight", "backsight_az", "instrument_height", "target_height", "target", *KINDS)
    value = lambda c: columns.get(c, F.lit(False) if c in ("opens", "shot") else F.lit(None).cast("double" if c in double else "string"))
    return lines.select("file", "line_no", *[value(c).alias(c) for c in names])


def scan_pnezd(lines: DataFrame) -> DataFrame:
    """(file, line_no, point, x, y, z, code): point number, northing, easting, height and code; other lines are skipped."""
    number, gap = r"(-?\d+(?:\.\d+)?)", r"(?:\s*,\s*|\s+)"
    pattern = rf"^\s*(\d+){gap}{number}{gap}{number}{gap}{number}(?:(?:\s*,|\s)(.*))?$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.where(F.col("line").rlike(pattern))
    return rows.select("file", "line_no", part(1).cast("long").alias("point"), part(3).cast("double").alias("x"), part(2).cast("double").alias("y"), part(4).cast("double").alias("z"), F.trim(part(5)).alias("code"))


#: Words and scale codes of the format.
GSI_WORD = r"(\d\d)[\d.]{2}([\d.]{2})([+-])(\d{8,16})"
GSI_SCALE = {"06": 1e-3, "16": 1e-4, "20": 1e-1}


def scan_gsi(lines: DataFrame) -> Field:
    """Words of 8 or 16 digits: 11 point, 21 and 22 angles (DDD MM SSsss), 31 to 33 distances, 84 instrument height, 85 and 87 target height.

    A line with 11 and 84 opens a setup.  The format has no backsight.
    """
    part = lambda i: F.regexp_extract_all("line", F.lit(GSI_WORD), F.lit(i))
    words = F.arrays_zip(part(1).alias("word"), part(2).alias("scale"), part(3).alias("sign"), part(4).alias("digits"))
    rows = lines.withColumn("words", words).where(F.size("words") > 0)
    last = lambda w: F.try_element_at(F.filter("words", lambda x: x["word"] == w), F.lit(-1))

    def signed(w: str, value: Callable[[Column], Column]) -> Column:
        return F.when(last(w)["sign"] == "-", -value(last(w)["digits"].cast("long"))).otherwise(value(last(w)["digits"].cast("long")))

    def length(w: str) -> Column:
        scale = F.lit(1.0)
        for code, factor in GSI_SCALE.items():
            scale = F.when(last(w)["scale"] == code, F.lit(factor)).otherwise(scale)
        return signed(w, lambda n: n * scale)

    angle = lambda w: F.radians(signed(w, _packed))
    opens = last("11").isNotNull() & last("84").isNotNull()
    point = last("11")["digits"].cast("long").cast("string")
    height = F.coalesce(F.nullif(length("87"), F.lit(0.0)), length("85"))
    return _field(_rows(rows, opens=opens, shot=~opens, occupied=point, instrument_height=length("84"), target_height=height, target=point, HA=angle("21"), VA=angle("22"), HD=length("31"), SD=length("32"), DZ=length("33")))


def scan_sdr(lines: DataFrame) -> Field:
    """Records 00 header, 06 and 07 instrument and target height, 09 setup, 08 observation.

    The header's last digit among its first 50 characters gives the units: 1
    metres, 2 US survey feet, 3 feet, 4 metres and gons.
    """
    code, rest = F.substring("line", 1, 2), F.expr("substring(line, 3)")
    flag = F.when(code == "00", F.regexp_extract(F.substring(rest, 1, 50), r"(\d)\D*$", 1))
    rows = lines.where(F.length("line") >= 2).withColumn("units", _last(flag))
    metres = F.when(F.col("units") == "2", US_FOOT).when(F.col("units") == "3", FOOT).otherwise(1.0)
    words = F.split(F.trim(rest), r"\s+")
    word = lambda i: F.get(words, F.lit(i))
    dms = lambda t: F.when(t.contains("."), _dotted(t)).otherwise(_packed(t.try_cast("long")))
    angle = lambda i: F.radians(F.when(F.col("units") == "4", _number(word(i)) * 0.9).otherwise(dms(word(i))))
    length = lambda i: _number(word(i)) * metres
    rows = rows.withColumns({"ih": F.coalesce(_last(F.when(code == "06", length(0))), F.lit(0.0)), "th": F.coalesce(_last(F.when(code == "07", length(0))), F.lit(0.0))})
    opens, shot = (code == "09") & (word(0) != ""), (code == "08") & (word(0) != "")
    return _field(_rows(rows, opens=opens, shot=shot, occupied=word(0), backsight=F.when(opens, word(1)), backsight_az=F.when(opens, angle(2)), instrument_height=F.col("ih"), target_height=F.col("th"), target=word(0), HA=angle(1), VA=angle(2), SD=length(3)))


def scan_nikon(lines: DataFrame) -> Field:
    """Comma records JE (units 2 US survey feet, 3 feet, else metres), ST setup, SS and HV observation; -- starts a comment."""
    part = F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x))
    at = lambda i: F.get("part", F.lit(i))
    rows = lines.where("trim(line) != '' and trim(line) not like '--%'").withColumn("part", part)
    rows = rows.withColumn("code", F.upper(at(0))).withColumn("units", _last(F.when(F.col("code") == "JE", at(2))))
    metres = F.when(F.col("units") == "2", US_FOOT).when(F.col("units") == "3", FOOT).otherwise(1.0)
    opens, shot = F.col("code") == "ST", F.col("code").isin("SS", "HV")
    rows = rows.withColumn("th", F.coalesce(_last(F.when(shot, _number(at(5)) * metres)), F.lit(0.0)))
    return _field(_rows(rows, opens=opens, shot=shot, occupied=at(1), backsight=F.when(opens, at(2)), backsight_az=F.when(opens, _angle(at(4))), instrument_height=F.coalesce(_number(at(3)), F.lit(0.0)) * metres, target_height=F.col("th"), target=at(1), HA=_angle(at(2)), VA=_angle(at(3)), SD=_number(at(4)) * metres))


def scan_rw5(lines: DataFrame) -> Field:
    """Records of two-letter keys: OC setup, BK its backsight, LS heights, SS observation; -- starts a comment."""
    part = F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x))
    rows = lines.where("trim(line) != '' and trim(line) not like '--%'").withColumn("part", part).withColumn("code", F.get("part", F.lit(0)))

    def value(*keys: str) -> Column:
        one = lambda k: F.nullif(F.substring(F.try_element_at(F.filter(F.slice("part", 2, 100), lambda p: F.upper(F.substring(p, 1, 2)) == k), F.lit(-1)), 3, 100), F.lit(""))
        return F.coalesce(*map(one, keys))

    opens, shot, amends = F.col("code") == "OC", F.col("code") == "SS", F.col("code") == "BK"
    ih = F.when(opens, _number(value("HI", "IH"))).when(F.col("code") == "LS", _number(value("HI")))
    rows = rows.withColumns({"ih": F.coalesce(_last(ih), F.lit(0.0)), "th": F.coalesce(_last(F.when(F.col("code") == "LS", _number(value("HR", "HT")))), F.lit(0.0))})
    back = F.when(amends, _angle(value("BC")))
    return _field(_rows(rows, opens=opens, shot=shot, occupied=F.coalesce(value("OP"), F.lit("")), backsight=F.when(back.isNotNull(), value("BP")), backsight_az=back, instrument_height=F.col("ih"), target_height=F.col("th"), target=F.coalesce(value("FP"), F.lit("")), HA=_angle(value("AZ", "HA")), VA=_angle(value("ZE", "VA")), SD=_number(value("SD"))))


def scan_rinex_header(lines: DataFrame) -> DataFrame:
    """(file, marker, receiver, x, y, z, sx, sy, sz) from the labelled header lines; a file without marker or position has no row."""
    label = F.upper(F.trim(F.expr("substring(line, 61)")))
    ended = F.max(label.contains("END OF HEADER").cast("int")).over(_upto().rowsBetween(Window.unboundedPreceding, -1))
    head = lines.withColumns({"label": label, "ended": F.coalesce(ended, F.lit(0))}).where("ended = 0")
    of = lambda name, start, size: F.max(F.when(F.col("label").contains(name), F.trim(F.substring("line", start, size))))
    got = head.groupBy("file").agg(
        of("MARKER NAME", 1, 60).alias("marker"), of("REC # / TYPE / VERS", 21, 20).alias("receiver"), *[of("APPROX POSITION XYZ", 1 + 14 * i, 14).try_cast("double").alias(c) for i, c in enumerate("xyz")]
    )
    return got.where("marker is not null and x is not null and y is not null and z is not null").withColumns({"sx": F.lit(2.0), "sy": F.lit(2.0), "sz": F.lit(4.0)})


def scan_nmea(lines: DataFrame) -> DataFrame:
    """(all columns of lines but line, lon, lat, alt, sx, sy, sz) of GGA sentences with a fix; batch or stream."""
    part = F.split("line", ",")
    at = lambda i: F.get("part", F.lit(i))
    rows = lines.withColumn("part", part).where(F.get("part", F.lit(0)).rlike(r"^\s*\$..GGA$") & (F.coalesce(at(6).try_cast("int"), F.lit(0)) > 0))

    def degrees(i: int) -> Column:
        v = _number(at(i))
        d = F.floor(v / 100)
        return F.when(at(i + 1).isin("S", "W"), -1.0).otherwise(1.0) * (d + (v - 100 * d) / 60)

    out = rows.withColumns({"lon": degrees(4), "lat": degrees(2), "alt": F.coalesce(_number(at(9)), F.lit(0.0)), "sx": F.lit(0.5), "sy": F.lit(0.5), "sz": F.lit(1.0)})
    return out.where("lon is not null and lat is not null").drop("line", "part")


def scan_jxl(elements: DataFrame) -> Field:
    """elements(file, line_no, line): a StationSetup or RegularObservation element in each line.

    An observation belongs to the setup that its StationID names, else to the
    file's first; a horizontal distance counts only without a slope distance.
    """
    fields = "ID, StationID, StationName, TheodoliteHeight, InstrumentHeight, BackSightPointName, BackSightAzimuth, TargetID, TargetName, PointName, HorizontalCircle, HorizontalAngle, VerticalCircle, ZenithAngle, SlopeDistance, HorizontalDistance, TargetHeight".split(", ")
    rows = elements.withColumn("e", F.from_xml("line", ", ".join(f"{f} string" for f in fields)))
    e = lambda *names: F.coalesce(*[F.col(f"e.{n}") for n in names])
    stations = rows.where("line like '<StationSetup%'").withColumn("setup", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long"))
    setups = stations.select("file", "setup", e("StationName", "StationID").alias("occupied"), F.coalesce(_number(e("TheodoliteHeight", "InstrumentHeight")), F.lit(0.0)).alias("instrument_height"), F.col("e.BackSightPointName").alias("backsight"), F.radians(_number(F.col("e.BackSightAzimuth"))).alias("backsight_az"))
    named = stations.groupBy("file", F.col("e.ID").alias("id")).agg(F.max(F.struct("setup", e("StationName", "StationID").alias("occupied"))).alias("s"))
    first = stations.groupBy("file").agg(F.min(F.struct("setup", e("StationName", "StationID").alias("occupied"))).alias("f"))
    shots = rows.where("line like '<RegularObservation%'").withColumn("id", F.col("e.StationID")).join(named, ["file", "id"], "left").join(first, "file", "left").withColumn("s", F.coalesce("s", "f"))
    sd = _number(F.col("e.SlopeDistance"))
    values = {"HA": F.radians(_number(e("HorizontalCircle", "HorizontalAngle"))), "VA": F.radians(_number(e("VerticalCircle", "ZenithAngle"))), "SD": sd, "HD": F.when(sd.isNull(), _number(F.col("e.HorizontalDistance")))}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])).alias("o")
    seen = shots.where("s is not null").select("file", "line_no", "s.setup", "s.occupied", e("TargetID", "TargetName", "PointName").alias("target"), kinds, F.coalesce(_number(F.col("e.TargetHeight")), F.lit(0.0)).alias("target_height"))
    observations = seen.where("o.value is not null").select("file", "line_no", "setup", "occupied", "target", "o.kind", "o.value", "target_height")
    return Field(setups, observations, shots.where("s is null").select("file", "line_no", F.lit("observation before any setup").alias("warning")))


#: Ways to read a field file's lines, by format; further ones can be added.
FORMATS: dict[str, Callable[[DataFrame], Field]] = {"gsi": scan_gsi, "sdr": scan_sdr, "nikon": scan_nikon, "rw5": scan_rw5, "jxl": scan_jxl}


def read_field(spark: SparkSession, path: str, kind: str) -> Field:
    """Field files of a registered format."""
    if kind == "jxl":
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        element = F.lit(r"(?s)(<(StationSetup|RegularObservation)\b.*?</\2>)")
        rows = files.select("file", F.posexplode(F.regexp_extract_all("value", element, F.lit(1))).alias("line_no", "line"))
        return FORMATS[kind](rows.withColumn("line", F.regexp_replace("line", r"\s+", " ")))
    return FORMATS[kind](scan_lines(spark, path))


def route_files(files: DataFrame) -> DataFrame:
    """files(file, head) with ``format``: by extension and the first characters; null where none fits."""
    ext, head = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)), F.col("head")
    rules = (
        ("gsi", ext.isin("gsi", "gsi8", "gsi16") & F.regexp_extract(head, r"^([^\n]*)", 1).rlike(GSI_WORD)),
        ("sdr", ext.isin("sdr", "sdr20", "sdr33") & head.startswith("00")),
        ("nikon", ext.isin("raw", "nik") & head.rlike(r"^(ST|JE|HV|SS|PT),")),
        ("rw5", ext.isin("rw5") & head.rlike(r"^(JB,|--|MO,)")),
        ("jxl", ext.isin("jxl", "xml") & head.rlike("JOBFile|<Trimble|JobXML")),
        ("rinex", (ext.isin("obs", "rnx") | ext.rlike(r"^\d\do$")) & F.substring(head, 1, 256).contains("RINEX VERSION")),
        ("nmea", head.rlike(r"^\s*(\$[^\n]*\n\s*)*\$G[PNLA]")),
        ("geojson", ext.isin("geojson", "json") & head.rlike(r'"type"\s*:\s*"Feature')),
        ("landxml", ext.isin("xml", "landxml")),
        ("xyz", ext.isin("xyz", "txt", "asc")),
    )
    found = F.lit(None).cast("string")
    for name, fits in reversed(rules):
        found = F.when(fits, name).otherwise(found)
    return files.withColumn("format", found)


def scan_xyz(lines: DataFrame) -> DataFrame:
    """(file, line_no, x, y, z) with heights in metres; # and ; start comments.

    A file's heights are in feet if its first point lies beyond 50,000, or else
    if any height is beyond 100.
    """
    text = F.trim(F.regexp_replace("line", "[#;].*$", ""))
    part = F.split(text, r"[\s,]+")
    rows = lines.select("file", "line_no", *[F.get(part, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")]).where("x is not null and y is not null and z is not null")
    about = rows.groupBy("file").agg(F.min_by(F.greatest(F.abs("x"), F.abs("y")), "line_no").alias("reach"), F.max(F.abs("z")).alias("height"))
    metres = F.when((F.col("reach") > 50_000) | (F.col("height") > 100), FOOT).otherwise(1.0)
    return rows.join(about, "file").select("file", "line_no", *[(F.col(c) * (metres if c == "z" else 1.0)).alias(c) for c in "xyz"])

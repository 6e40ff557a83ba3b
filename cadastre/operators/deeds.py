"""Land descriptions as text: metes and bounds, public land survey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions import cogo, rings

#: Marks between the parts of an angle, and words for compass points: made blanks and letters before anything is read.
_MARKS = r"(?i)(?:[°º*'′’\"″”]|(?<=[0-9NSns])-(?=[0-9])|(?<=[0-9])-(?=[EWew])|\b(?:degrees?|deg|minutes?|min|seconds?|sec)\b\.?)"
_NUMBER = r"(\d+(?:\.\d+)?)"
_DMS = rf"{_NUMBER}(?: +{_NUMBER})?(?: +{_NUMBER})?"
_BEARING = rf"\b([NS]) *{_DMS} *([EW])\b"
#: Longer spellings first, so that none stops a longer one.
_UNIT = "(" + "|".join(sorted(cogo.UNITS, key=len, reverse=True)) + r")\b"
_DISTANCE = rf"(?i)\b{_NUMBER}\s*{_UNIT}"
_TURN = r"(?i)\b(?:curve|curving|arc)\b[^;]*?\b(left|right|counter-?clockwise|clockwise)\b"
#: What is told of a curve, each wherever it stands in the clause.
_RADIUS = rf"(?i)\bradius\s+(?:of\s+)?{_NUMBER}\s*{_UNIT}"
_ARC = rf"(?i)(?<!\bchord )\b(?:arc\s+)?(?:length|distance)\s+of\s+{_NUMBER}\s*{_UNIT}"
_CHORD = rf"(?i)\bchord\s+(?:length\s+)?(?:of\s+)?{_NUMBER}\s*{_UNIT}"
_DELTA = rf"(?i)\b(?:delta|central angle)\s+(?:angle\s+)?(?:of\s+)?{_DMS}"
_CHORD_BEARING = rf"(?i)\bchord\s+(?:bears|bearing)\s+[^;]*?{_BEARING}"
_BEGINNING = r"(?i)\b(?:true\s+)?point\s+of\s+beginning\b|\bP\.?O\.?B\b\.?"
_TOWNSHIP = r"(?i)\bT(?:ownship)?\.?\s*(\d{1,3})\s*(N|S)"
_RANGE = r"(?i)\bR(?:ange)?\.?\s*(\d{1,3})\s*(E|W)"
_SECTION = r"(?i)\bSec(?:tion)?\.?\s*(\d{1,2})"
_QUARTER = r"(?i)\b(NE|NW|SE|SW|Northeast|Northwest|Southeast|Southwest)\s*(?:1/4|¼|quarter)"
#: Metres of a section's side.
MILE = 1609.344
#: Principal lines from which townships are counted.
PRINCIPAL_LINES = (
    "1st", "2nd", "3rd", "4th", "5th", "6th", "Black Hills", "Boise", "Chickasaw", "Choctaw", "Cimarron", "Copper River", "Fairbanks", "Gila and Salt River", "Humboldt", "Huntsville", "Indian", "Kateel River", "Louisiana",
    "Michigan", "Mount Diablo", "Navajo", "New Mexico", "Salt Lake", "San Bernardino", "Seward", "St. Helena", "St. Stephens", "Tallahassee", "Uintah Special", "Umiat", "Ute", "Washington", "Willamette", "Wind River",
    "Ohio River Survey", "Connecticut Western Reserve",
)
_PRINCIPAL = r"(?i)\b(" + "|".join(m.replace(".", r"\.") for m in sorted(PRINCIPAL_LINES, key=len, reverse=True)) + r")\s*(?:(?:Principal\s+)?[A-Z]\w+(?<=ian)\b|P\.?\s*M\b)"


def _plain(text: Column) -> Column:
    """The text with blanks for the marks of angles, and letters for compass points at numbers."""
    letters = F.regexp_replace(F.regexp_replace(text, _MARKS, " "), r"(?i)\b(?:(N)orth|(S)outh)(?= *\d)", "$1$2")
    return F.regexp_replace(letters, r"(?i)(?<=\d) +(e|w)(?:ast|est)\b", " $1")


def _part(column: Column | str, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def _groups(column: Column, pattern: str, count: int) -> Column:
    """The first match's groups as an array, empty texts for those without a part in it: the text is searched once, the groups are taken from what was found."""
    cut = "\u0001".join(f"${i + 1}" for i in range(count))
    return F.split(F.regexp_replace(F.regexp_extract(column, pattern, 0), pattern, cut), "\u0001")


def _group(groups: Column, i: int) -> Column:
    return F.nullif(F.get(groups, F.lit(i)), F.lit(""))


def _angle(groups: Column, first: int = 0) -> Column:
    """Radians of the degrees, minutes and seconds in three groups."""
    value = lambda i: _group(groups, first + i).cast("double")
    return F.radians(value(0) + F.coalesce(value(1), F.lit(0.0)) / 60 + F.coalesce(value(2), F.lit(0.0)) / 3600)


def _quadrant(column: Column, pattern: str) -> Column:
    """Azimuth of a quadrant bearing: letter, three parts, letter."""

    def of(groups: Column) -> Column:
        angle, ns, ew, pi = _angle(groups, 1), F.upper(_group(groups, 0)), F.upper(_group(groups, 4)), F.lit(cogo.TWO_PI / 2)
        return cogo.azimuth(F.when(ns == "N", F.when(ew == "E", angle).otherwise(-angle)).otherwise(F.when(ew == "E", pi - angle).otherwise(pi + angle)))

    return rings.let(_groups(column, pattern, 5), of)


def _metres(column: Column, pattern: str) -> Column:
    factor = F.create_map(*[F.lit(v) for item in cogo.UNITS.items() for v in item])
    return rings.let(_groups(column, pattern, 2), lambda g: _group(g, 0).cast("double") * F.element_at(factor, F.lower(_group(g, 1))))


def parse_deeds(docs: DataFrame) -> DataFrame:
    """(doc, seq, clause, kind, az, metres, radius, delta, arc, chord, clockwise): the calls of docs(doc, text), one row per THENCE.

    kind is curve (told by radius, arc or delta), line, or unparsed (no bearing
    or no distance).  A curve's az and metres are those of its chord; what two
    of its elements tell of the others is filled in.  The text before the first
    THENCE is no call; a text without THENCE or a null text gives none.
    """
    clauses = F.transform(F.split(F.regexp_replace("text", r"\s+", " "), r"(?i)\bthence\b"), lambda c: F.struct(c.alias("clause"), _plain(c).alias("plain")))

    def told(c: Column) -> Column:
        clause, plain = c["clause"], c["plain"]
        bends = F.struct(_metres(clause, _RADIUS).alias("radius"), rings.let(_groups(plain, _DELTA, 3), _angle).alias("delta"), _metres(clause, _ARC).alias("arc"), _metres(clause, _CHORD).alias("chord"), _quadrant(plain, _CHORD_BEARING).alias("chord_az"))
        runs = F.struct(_quadrant(plain, "(?i)" + _BEARING).alias("line_az"), _metres(clause, _DISTANCE).alias("length"))

        # Only a clause that tells a turn is searched for a curve's parts, and only what is no curve for a line's.
        def turned(turn: Column) -> Column:
            def bent(bend: Column) -> Column:
                curve = F.coalesce(bend["radius"], bend["arc"], bend["delta"]).isNotNull()
                return F.struct(clause.alias("clause"), turn.alias("turn"), curve.alias("curve"), bend.alias("bend"), F.when(~curve, runs).alias("run"))

            return rings.let(F.when(turn.isNotNull(), bends), bent)

        return rings.let(F.lower(_part(clause, _TURN, 1)), turned)

    # What the patterns find is computed once for each clause, before anything refers to it.
    calls = docs.select("doc", F.posexplode(F.transform(clauses, told)).alias("seq", "e")).where("seq > 0").select("doc", "seq", "e.clause", "e.turn", "e.curve", "e.bend.*", "e.run.*")
    filled = curve_fill(calls.withColumns({c: F.when(F.col("curve"), F.col(c)) for c in ("radius", "delta", "arc", "chord")}))
    curve = F.col("curve")
    filled = filled.withColumns({"az": F.when(curve, F.col("chord_az")).otherwise(F.col("line_az")), "metres": F.when(curve, F.col("chord")).otherwise(F.col("length")), "clockwise": F.when(curve, F.col("turn").isin("right", "clockwise"))})
    kind = F.when(curve, "curve").when(F.col("az").isNull() | F.col("metres").isNull(), "unparsed").otherwise("line")
    return filled.withColumn("kind", kind).select("doc", "seq", "clause", "kind", "az", "metres", "radius", "delta", "arc", "chord", "clockwise")


def beginnings(docs: DataFrame) -> DataFrame:
    """(doc, beginning): how docs(doc, text) name their point of beginning, null where they don't."""
    return docs.select("doc", _part("text", _BEGINNING, 0).alias("beginning"))


def failed_deeds(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """(doc, reason) of the docs without a single call that could be read."""
    read = calls.where("kind != 'unparsed'").select("doc").distinct()
    return docs.join(read, "doc", "left_anti").select("doc", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("no calls").alias("reason"))


def curve_fill(curves: DataFrame) -> DataFrame:
    """curves(radius, delta, arc, chord) with what two of them, the radius among them, tell of the rest."""
    delta = F.coalesce(F.col("delta"), F.col("arc") / F.col("radius"), 2 * F.asin(F.col("chord") / (2 * F.col("radius"))))
    filled = curves.withColumn("delta", delta)
    return filled.withColumns({"arc": F.coalesce("arc", F.col("radius") * F.col("delta")), "chord": F.coalesce("chord", 2 * F.col("radius") * F.sin(F.col("delta") / 2))})


def parse_plss(docs: DataFrame) -> DataFrame:
    """docs(doc, text) to (doc, township, ns, range, ew, section, quarters, principal); quarters in text order. Others are null."""
    names = F.regexp_extract_all("text", F.lit(_QUARTER), F.lit(1))
    quarters = F.transform(names, lambda q: F.upper(F.when(F.length(q) == 2, q).otherwise(F.concat(F.substring(q, 1, 1), F.substring(q, 6, 1)))))
    part = lambda p, i: _part("text", p, i)
    return docs.select("doc", part(_TOWNSHIP, 1).cast("int").alias("township"), F.upper(part(_TOWNSHIP, 2)).alias("ns"), part(_RANGE, 1).cast("int").alias("range"), F.upper(part(_RANGE, 2)).alias("ew"), part(_SECTION, 1).cast("int").alias("section"), quarters.alias("quarters"), part(_PRINCIPAL, 1).alias("principal"))


def plss_boxes(parsed: DataFrame) -> DataFrame:
    """(doc, x, y, side, acres): south-west corner within the township and side, in metres.

    Sections 1 to 36 run in a serpentine from the north-east; each quarter in
    turn halves the box. Other sections give no row.
    """
    i = F.col("section") - 1
    row = F.floor(i / 6)
    col = F.when(row % 2 == 0, 5 - i % 6).otherwise(i % 6)
    start = F.struct((col * F.lit(MILE)).alias("x"), ((5 - row) * F.lit(MILE)).alias("y"), F.lit(MILE).alias("side"))

    def narrow(box, quarter):
        half = box["side"] / 2
        x = box["x"] + F.when(quarter.endswith("E"), half).otherwise(0.0)
        y = box["y"] + F.when(quarter.startswith("N"), half).otherwise(0.0)
        return F.struct(x.alias("x"), y.alias("y"), half.alias("side"))

    boxes = parsed.where("section between 1 and 36").withColumn("box", F.aggregate("quarters", start, narrow))
    return boxes.select("doc", "box.x", "box.y", "box.side", (F.lit(640.0) / F.pow(F.lit(4.0), F.size("quarters"))).alias("acres"))


#: Words that open an exception, a reservation or a burden, and the line that heads a tract.
_CARVED = r"(?:(?:SAVE|LESS|SAVING)\s+AND\s+EXCEPT(?:ING)?|EXCEPT(?:ING)?\s+(?:THE|(?:FOR\s+)?THAT))"
_EXCEPT = rf"(?i)(?:{_CARVED}|RESERVING\s+UNTO|SUBJECT\s+TO\s+THAT\s+CERTAIN)"
_HEAD = r"(?im)^[ \t]*(?:TRACT|PARCEL)[ \t]+\w+[ \t]*[:-]?"
#: Most characters of a reservation; what follows is not part of it.
RESERVED_MOST = 800
SQUARE_METRES_PER_ACRE = 4046.8564224


def deed_flags(docs: DataFrame) -> DataFrame:
    """docs(doc, text) to (doc, is_plss, has_exception, is_multi_tract); a null text has none of them."""
    has = lambda p: F.coalesce(F.col("text").rlike(p), F.lit(False))
    return docs.select("doc", (has(_TOWNSHIP) & has(_RANGE) & has(_SECTION)).alias("is_plss"), has(_EXCEPT).alias("has_exception"), has(_HEAD).alias("is_multi_tract"))


def deed_boundaries(calls: DataFrame) -> DataFrame:
    """(doc, n, dx, dy, misclosure, perimeter, ratio, ring): the boundary that calls(doc, seq, az, metres) run from the origin.

    Curves run along their chords.  A deed with a call that lacks bearing or
    distance has none, see deed_rejects.  ratio is the perimeter for one unit of
    misclosure, null if that is below a micrometre.  ring holds the corners in
    the order of the calls.
    """
    upto = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = calls.select("doc", "seq", "metres", (F.col("metres") * F.sin("az")).alias("ex"), (F.col("metres") * F.cos("az")).alias("ey"))
    run = run.withColumns({"x": F.sum("ex").over(upto), "y": F.sum("ey").over(upto)})
    corners = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    whole = run.groupBy("doc").agg(F.count("*").alias("n"), F.count("ex").alias("known"), F.sum("ex").alias("dx"), F.sum("ey").alias("dy"), F.sum("metres").alias("perimeter"), corners.alias("corners")).where("n = known")
    whole = whole.withColumn("misclosure", F.hypot("dx", "dy")).withColumn("ring", F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), "corners"))
    return whole.select("doc", "n", "dx", "dy", "misclosure", "perimeter", F.when(F.col("misclosure") >= 1e-6, F.col("perimeter") / F.col("misclosure")).alias("ratio"), "ring")


def deed_rejects(calls: DataFrame) -> DataFrame:
    """(doc, calls, curves): deeds without a boundary, with the number of calls and of curves among them that lack bearing or distance."""
    lacks = F.col("az").isNull() | F.col("metres").isNull()
    return calls.where(lacks).groupBy("doc").agg(F.count("*").alias("calls"), F.count(F.when(F.col("kind") == "curve", 1)).alias("curves"))


def split_tracts(docs: DataFrame) -> DataFrame:
    """docs(doc, text) to (doc, pos, role, part): parent, additional, exception and reservation parts in text order.

    The first headed tract, or without headers the text before the first
    marker, is the parent. Text before the first header, and blank or null
    text, gives no part.
    """
    marked = F.regexp_replace(F.regexp_replace("text", _HEAD, "\u0001$0"), _EXCEPT, "\u0001$0")
    parts = docs.select("doc", F.transform(F.split(marked, "\u0001"), lambda p: F.trim(p)).alias("parts"))
    heads = lambda p: p.rlike("^" + _HEAD)
    rows = parts.withColumn("first", F.array_position(F.transform("parts", heads), True)).select("doc", "first", F.posexplode("parts").alias("pos", "part")).where("part != ''")
    part = F.col("part")
    role = (
        F.when(part.rlike(r"(?i)^RESERVING"), "reservation")
        .when(part.rlike("^" + _EXCEPT), "exception")
        .when(heads(part), F.when(F.col("pos") + 1 == F.col("first"), "parent").otherwise("additional"))
        .when(F.col("first") == 0, "parent")
    )
    rows = rows.withColumn("role", role).where("role is not null")
    return rows.select("doc", "pos", "role", F.when(F.col("role") == "reservation", F.substring(part, 1, RESERVED_MOST)).otherwise(part).alias("part"))


def net_area(areas: DataFrame) -> DataFrame:
    """(doc, net, acres, exact, warning) of areas(doc, role, area) in square metres: the parent without its exceptions, not below nothing.

    Additional tracts do not count.  exact is false where an exception's area
    isn't known (null), or the exceptions are more than the parent; warning says so.
    """
    of = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("area"))), F.lit(0.0))
    unknown = F.count(F.when((F.col("role") == "exception") & F.col("area").isNull(), 1))
    net = areas.groupBy("doc").agg(F.greatest(of("parent") - of("exception"), F.lit(0.0)).alias("net"), (of("exception") > of("parent")).alias("over"), unknown.alias("unknown"))
    warning = F.when(F.col("unknown") > 0, "exception without area").when(F.col("over"), "exceptions exceed the parent")
    return net.select("doc", "net", (F.col("net") / SQUARE_METRES_PER_ACRE).alias("acres"), warning.isNull().alias("exact"), warning.alias("warning"))


def all_tracts(*tracts: DataFrame) -> DataFrame:
    """Parents, exceptions, additional tracts and reservations, from however many tables(doc, role, ..), in one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tracts)


def training_pairs(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, doc, text, target): each text of docs(doc, text) with its calls as JSON; id is the start of the text's hash. Texts without calls are left out."""
    target = calls.groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "kind", "az", "metres", "radius")))).alias("target"))
    return docs.join(target, "doc").select(F.substring(F.sha2("text", 256), 1, 16).alias("id"), "doc", "text", "target")

"""Title commitments, plats and surveyors' certificates: texts and records to rows of what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions.rings import let
from cadastre.operators.documents import after, classify_items, recording_refs, until

#: What a commitment's fields are called.
LABELS = {"effective": ("effective date",), "insured": ("insured",), "vested": ("is vested in",), "legal": ("legal description", "land referred to")}
#: The first letters of the months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Two-digit years from here on are of the last century.
CENTURY = 70
#: Least characters of an item's text.
ITEM_LEAST = 6
#: Estates by the words that name them, the first found counts.
ESTATES = {"fee_simple": "fee simple", "leasehold": "leasehold", "easement": "easement", "life_estate": "life estate"}


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line, schedule, part): the lines of docs(doc, text) with the schedule that the last heading before or on them names (A, B1 requirements, B2 exceptions), part counts headings.

    A heading is a line whose words begin with SCHEDULE and A, or with SCHEDULE and B and hold REQUIREMENTS or EXCEPTIONS.
    """
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.rtrim("line", F.lit("\r")))
    words = F.split(F.trim(F.regexp_replace(F.upper("line"), "[^A-Z]+", " ")), " ")
    of_b = (F.get(words, F.lit(0)) == "SCHEDULE") & F.get(words, F.lit(1)).startswith("B")
    heading = F.when((F.get(words, F.lit(0)) == "SCHEDULE") & (F.get(words, F.lit(1)) == "A"), "A").when(of_b & F.array_contains(words, "REQUIREMENTS"), "B1").when(of_b & F.array_contains(words, "EXCEPTIONS"), "B2")
    so_far = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("heading", heading)
    return rows.select("doc", "pos", "line", F.last("heading", ignorenulls=True).over(so_far).alias("schedule"), F.count("heading").over(so_far).alias("part"), F.col("heading").isNotNull().alias("heads"))


def _sections(docs: DataFrame) -> DataFrame:
    """The lines of _lines() under the first heading of each schedule, but the headings of B1 and B2."""
    rows = _lines(docs).where("schedule is not null")
    first = rows.groupBy("doc", "schedule").agg(F.min("part").alias("part"))
    return rows.join(first, ["doc", "schedule", "part"]).where("not heads or schedule = 'A'")


def _day(text: Column) -> Column:
    """The date at the start of a text: a month's name or its first letters, day and year, or three numbers in that order."""
    parts = F.slice(F.split(F.regexp_replace(F.substring(text, 1, 40), r"[^0-9A-Za-z]+", " "), " "), 1, 3)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.get(parts, F.lit(0)), 1, 3)))
    month = F.when(named > 0, named).otherwise(F.get(parts, F.lit(0)).try_cast("int"))
    year = F.get(parts, F.lit(2)).try_cast("int")
    whole = F.when(year >= 100, year).when(year >= CENTURY, year + 1900).otherwise(year + 2000)
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), month.cast("string"), F.get(parts, F.lit(1))), F.lit("yyyy-M-d")).cast("date")


def _money(text: Column) -> Column:
    """The number after the first dollar sign, its commas left out."""
    rest = F.ltrim(F.when(F.instr(text, "$") > 0, F.substring(text, F.instr(text, "$") + 1, F.lit(40))))
    return F.rtrim(F.translate(F.regexp_extract(rest, "^[0-9.,]+", 0), ",", ""), F.lit(".")).try_cast("double")


def parse_schedule_a(docs: DataFrame) -> DataFrame:
    """(doc, effective, insured, vested, legal, estate, amount) of docs(doc, text); without a Schedule A the whole text is read.

    A field is what stands after its label up to the end of the line, the legal
    description up to the end of the schedule.
    """
    own = _sections(docs).where("schedule = 'A'").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("section"))
    rows = docs.select("doc", "text").join(own, "doc", "left").select("doc", F.coalesce("section", "text").alias("s"))
    low, estate = F.lower("s"), F.lit("unknown")
    for kind, words in reversed(ESTATES.items()):
        estate = F.when(low.contains(words), kind).otherwise(estate)
    line = lambda field: until(after(F.col("s"), LABELS[field]), ("\n",)).alias(field)
    legal = F.nullif(F.trim(after(F.col("s"), LABELS["legal"]), F.lit(" \t\r\n")), F.lit(""))
    return rows.select("doc", _day(after(F.col("s"), LABELS["effective"])).alias("effective"), line("insured"), line("vested"), legal.alias("legal"), estate.alias("estate"), _money(F.col("s")).alias("amount"))


def commitment_items(docs: DataFrame) -> DataFrame:
    """(doc, schedule, pos, number, text, kind, recording_ref): numbered requirements (B1) and exceptions (B2) of docs(doc, text).

    An item begins with a line whose first word is a number of up to three digits
    or a letter with a full stop, or a digit or letter in brackets.
    """
    rows = _sections(docs).where("schedule != 'A'").withColumn("word", F.substring_index(F.translate(F.ltrim("line", F.lit(" \t")), "\t", " "), " ", 1))
    core = F.translate("word", ".()", "")
    single, digits = core.rlike("^[0-9A-Za-z]$"), F.length(core).between(1, 3) & (F.translate(core, "0123456789", "") == "")
    numbered = ((F.col("word") == F.concat(core, F.lit("."))) & (digits | single)) | ((F.col("word") == F.concat(F.lit("("), core, F.lit(")"))) & single)
    rows = rows.withColumn("number", F.when(numbered & (F.length(F.ltrim("line", F.lit(" \t"))) > F.length("word")), F.col("word")))
    rows = rows.withColumn("item", F.count("number").over(Window.partitionBy("doc", "schedule").orderBy("pos"))).where("item > 0")
    own = rows.withColumn("line", F.when(F.col("number").isNotNull(), F.expr("substring(ltrim(' \t', line), length(word) + 1)")).otherwise(F.col("line")))
    whole = own.groupBy("doc", "schedule", F.col("item").cast("int").alias("pos")).agg(F.max("number").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    items = whole.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where(F.length("text") >= ITEM_LEAST)
    return recording_refs(classify_items(items)).withColumn("recording_ref", F.when(F.col("schedule") == "B2", F.col("recording_ref")))


#: Words for ways, and what a plat's parts are called.
WAYS = ("Street", "St", "Avenue", "Ave", "Boulevard", "Blvd", "Drive", "Dr", "Lane", "Ln", "Road", "Rd", "Court", "Ct", "Circle", "Cir", "Way", "Place", "Pl", "Trail", "Parkway", "Pkwy")
COMMON_AREAS = {"Common Area": "common_area", "Open Space": "common_area", "Detention Pond": "drainage", "Drainage Easement": "drainage", "Park": "park", "HOA Tract": "common_area", "Future Development": "future_development"}
#: Before a plat's name, after it, and before where it is recorded.
NAMED, NAME_ENDS = ("plat of ", "known as ", "subdivision of "), (" as recorded", " recorded", " according")
RECORDED, RECORDED_ENDS = ("recorded in ", "inst. no.", "cabinet ", "slide ", "volume ", "vol. ", "book "), (" of ", " page ", " pg ")
#: Metres of the units in which widths are told.
WIDTHS = {"foot": 0.3048, "feet": 0.3048, "ft": 0.3048, "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0}
#: How far after a street's name its width may stand.
NEAR = 120


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _bare(word: Column) -> Column:
    """A word without the marks around it."""
    return F.regexp_replace(word, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")


def plat_names(docs: DataFrame) -> DataFrame:
    """(doc, name, recording) of docs(doc, text): what stands between the words for each; a name begins with a capital and has no stop in it."""
    rows = docs.select("doc", F.regexp_replace("text", r"\s+", " ").alias("t"))
    name = let(until(after(F.col("t"), NAMED), NAME_ENDS), lambda n: F.when(n.rlike("^[A-Z]") & ~n.rlike("[.;:]"), n))
    recording = let(until(after(F.col("t"), RECORDED), RECORDED_ENDS), lambda n: F.when(~n.rlike("[;:]"), n))
    return rows.select("doc", F.coalesce(name, F.lit("Unnamed Subdivision")).alias("name"), recording.alias("recording"))


def _named(docs: DataFrame, word: str) -> DataFrame:
    """(doc, at, sentence, words, i) for every place i among the words of a sentence where ``word`` stands."""
    sentences = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), r"(?<=[.;]) (?=[A-Z])")
    rows = docs.select("doc", F.posexplode(sentences).alias("at", "sentence")).withColumn("words", F.split("sentence", " "))
    here = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.contains(F.lower(F.get("words", i)), F.lit(word)) & (F.lower(_bare(F.get("words", i))) == word))  # most words go without a pattern
    return rows.select("doc", "at", "sentence", "words", F.explode(here).alias("i"))


def plat_lots(docs: DataFrame) -> DataFrame:
    """(doc, number, block, text): each lot of docs(doc, text) once, with the first sentence that names it: Lot, a number that may end in a letter, and Block with its name after a comma."""
    next_ = lambda k: F.get("words", F.col("i") + k)
    number, comma = _bare(next_(1)), F.endswith(next_(1), F.lit(","))
    block = F.when(comma & (F.lower(next_(2)) == "block"), F.nullif(_bare(next_(3)), F.lit("")))
    rows = _named(docs, "lot").select("doc", "at", "i", F.col("sentence").alias("text"), number.alias("number"), block.alias("block")).where(F.col("number").rlike("^[0-9]+[A-Za-z]?$"))
    return rows.groupBy("doc", "number", "block").agg(F.min_by("text", F.struct("at", "i")).alias("text"))


def plat_streets(docs: DataFrame) -> DataFrame:
    """(doc, name, width_m): each street once, with the width told within NEAR characters after its first naming.

    A street's name is a run of capitalised words without marks between them that ends in a word for a way.
    """
    rows = docs.select("doc", _words(F.col("text")).alias("words"))
    marked = F.transform("words", lambda w: let(_bare(w), lambda b: F.struct(b.alias("bare"), b.rlike("^[A-Z][a-z]+$").alias("capital"), w.rlike("[^A-Za-z]$").alias("stops"), b.isin(*WAYS).alias("way"))))
    at = lambda i: F.get("marked", i)
    fresh = F.filter(F.sequence(F.lit(0), F.size("marked") - 1), lambda i: (i == 0) | ~at(i)["capital"] | ~at(i - 1)["capital"] | at(i - 1)["stops"])
    rows = rows.withColumn("marked", marked).withColumn("fresh", fresh)
    # A run goes from one fresh word to the next; it is a name from its first word to its last one for a way.
    end = lambda j: F.coalesce(F.get("fresh", j + 1), F.size("marked"))
    runs = F.filter(F.transform("fresh", lambda i, j: F.struct(i.alias("first"), end(j).alias("end"))), lambda r: at(r["first"])["capital"] & (r["end"] - r["first"] > 1))
    last = lambda r: F.array_max(F.filter(F.sequence(r["first"], r["end"] - 1), lambda k: at(k)["way"]))
    named = F.filter(F.transform(runs, lambda r: F.struct(r["first"].alias("first"), last(r).alias("last"))), lambda r: r["last"] > r["first"])
    rows = rows.withColumn("run", F.explode(named)).select("doc", "words", "run.first", "run.last")
    name = F.transform(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1), _bare)
    told = _words(F.translate(F.substring(F.array_join(F.slice("words", F.col("last") + 2, F.lit(NEAR)), " "), 1, NEAR), "-", " "))
    metres = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    widths = F.transform(told, lambda w, i: w.try_cast("double") * F.try_element_at(metres, F.lower(_bare(F.coalesce(F.get(told, i + 1), F.lit(""))))))
    rows = rows.select("doc", "first", F.array_join(name, " ").alias("name"), F.get(F.array_compact(widths), F.lit(0)).alias("width_m"))
    return rows.groupBy("doc", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "width_m"), "first").alias("s")).select("doc", "s.name", "s.width_m")


def plat_common_areas(docs: DataFrame) -> DataFrame:
    """(doc, label, kind) of the common areas that docs(doc, text) name."""
    rules = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col("text").rlike(rf"(?i)\b{label}\b").alias("hit")) for label, kind in COMMON_AREAS.items()])
    return docs.select("doc", F.explode(F.filter(rules, lambda x: x["hit"])).alias("r")).select("doc", "r.label", "r.kind")


def plat_block_counts(docs: DataFrame) -> DataFrame:
    """(doc, block, lots): lots of every block that docs(doc, text) name, blocks without lots too."""
    blocks = _named(docs, "block").select("doc", F.nullif(_bare(F.get("words", F.col("i") + 1)), F.lit("")).alias("block")).where("block is not null").distinct()
    return blocks.join(plat_lots(docs).select("doc", "block", "number"), ["doc", "block"], "left").groupBy("doc", "block").agg(F.count("number").alias("lots"))


#: Table A items.
TABLE_A = ("1", "2", "3", "4", "5", "6a", "6b", "7a", "7b", "7c", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21a", "21b")


def validate_certificates(certs: DataFrame, states: list[str]) -> DataFrame:
    """(cert_id, severity, issue) of certs(cert_id, type, license_state, license_exp, state, issue, field_end, flood_zone, accuracy, alta_items).

    states: those with a statutory text of their own.
    """
    c = F.col
    alta, items = c("type") == "alta_nsps", F.coalesce(F.size("alta_items"), F.lit(0)) > 0
    rules = (
        (F.upper("license_state") != F.upper("state"), "warning", "licensed in another state"),
        (c("license_exp") < c("issue"), "error", "licence expired before issue"),
        (c("field_end") > c("issue"), "error", "field work after issue"),
        (alta & c("accuracy").isNull(), "warning", "no accuracy class"),
        (~alta & items, "error", "Table A items on another certificate"),
        ((c("type") == "elevation") & (F.coalesce("flood_zone", F.lit("")) == ""), "error", "no flood zone"),
        (~F.upper("state").isin(*states), "warning", "no statutory text for the state"),
    )
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"))) for cond, severity, issue in rules])
    return certs.select("cert_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("cert_id", "i.severity", "i.issue")


def alta_missing_items(certs: DataFrame) -> DataFrame:
    """(cert_id, missing): Table A items that certs(cert_id, type, alta_items, required) lack; null on a certificate of another type."""
    alta = certs.where("type = 'alta_nsps'")
    required = alta.select("cert_id", F.explode(F.array_distinct("required")).alias("missing"))
    have = alta.select("cert_id", F.explode("alta_items").alias("missing"))
    other = certs.where("type != 'alta_nsps' or type is null").select("cert_id", F.lit(None).cast("string").alias("missing"))
    return required.join(have, ["cert_id", "missing"], "left_anti").unionByName(other)

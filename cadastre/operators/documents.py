"""Title commitments, field codes and model replies as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions.rings import let

# Kinds of schedule items and the words that tell them, the first kind that matches counts.
REQUIREMENTS = {
    "mortgage_payoff": ("payoff", "release of mortgage", "satisfy mortgage", "pay off"),
    "deed_delivery": ("deed of conveyance", "warranty deed", "deliver deed"),
    "judgment_release": ("judgment", "release of judgment"),
    "lien_release": ("release of lien", "lien must be", "lien shall be"),
    "survey_required": ("survey",),
    "affidavit": ("affidavit",),
    "probate": ("probate", "letters testamentary", "letters of administration"),
    "tax_payment": ("ad valorem", "current taxes", "delinquent tax"),
    "hoa_letter": ("homeowner association", "h.o.a", "hoa"),
    "entity_authority": ("certificate of authority", "good standing", "operating agreement", "borrowing resolution"),
    "power_of_attorney": ("power of attorney",),
    "correction_deed": ("correction deed", "scrivener", "correctly recite"),
    "encroachment": ("encroach",),
}
EXCEPTIONS = {
    "utility_easement": ("utility easement",),
    "access_easement": ("access easement", "ingress", "egress"),
    "drainage_easement": ("drainage easement",),
    "conservation_easement": ("conservation easement",),
    "easement": ("easement",),
    "hoa": ("homeowners association", "h.o.a", " hoa "),
    "ccr": ("covenants", "restrictions", "ccr", "c.c.r"),
    "oil_gas_lease": ("oil and gas lease", "oil, gas"),
    "mineral_reservation": ("mineral", "reserved by"),
    "life_estate": ("life estate",),
    "lease": ("lease",),
    "mortgage": ("deed of trust", "mortgage"),
    "judgment": ("judgment",),
    "delinquent_taxes": ("delinquent",),
    "taxes_not_yet_due": ("not yet due", "ad valorem taxes for"),
    "lien": ("lien",),
    "survey_exception": ("survey",),
    "riparian": ("riparian", "littoral"),
    "party_wall": ("party wall",),
    "encroachment": ("encroach",),
    "general": ("rights of parties in possession", "matters of survey", "matters arising"),
}
#: Kinds of high risk, on either schedule.
RISKY_REQUIREMENTS = ("lien_release", "judgment_release", "probate", "correction_deed", "encroachment")
RISKY_EXCEPTIONS = ("lien", "judgment", "mortgage", "delinquent_taxes", "encroachment", "mineral_reservation", "oil_gas_lease")
#: Words after which a record's place or number stands.
RECORD_LABELS = ("recorded in", "recorded on", "recording no.", "recording number", "instrument no.", "inst. no.")
_CODE = r"(?i)^([+\-]|BEG|END)?([A-Z]+)([0-9]+)?$"


def after(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first of the labels that the text holds, in any case; blanks and a colon between are left out; null without one."""
    places = lambda low: F.array_min(F.array_compact(F.array(*[F.when(F.instr(low, x) > 0, F.instr(low, x) + len(x)) for x in labels])))
    return let(F.lower(text), lambda low: F.ltrim(F.substring(text, places(low), F.length(text)), F.lit(": \t\r\n")))


def until(text: Column, stops: tuple[str, ...]) -> Column:
    """The text before the first of the stops, in any case, without blanks around; null if that is empty."""

    def cut(t: Column, low: Column) -> Column:
        least = F.array_min(F.array_compact(F.array(*[F.nullif(F.instr(low, x), F.lit(0)) for x in stops], F.length(t) + 1)))
        return F.nullif(F.trim(F.substring(t, F.lit(1), least - 1), F.lit(" \t\r\n,")), F.lit(""))

    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda s: cut(s["t"], s["low"]))


def classified(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The first kind of ``rules`` one of whose words the text holds, in any case; other if none; null text is null."""
    low = F.lower(text)
    kinds = [F.when(low.contains(words[0]) if len(words) == 1 else F.greatest(*[low.contains(w) for w in words]), kind) for kind, words in rules.items()]
    return F.when(text.isNotNull(), F.coalesce(*kinds, F.lit("other")))


def classify_items(items: DataFrame) -> DataFrame:
    """items(doc, schedule, text) with their kind: schedule B1 holds requirements, any other one exceptions."""
    kind = F.when(F.col("schedule") == "B1", classified(F.col("text"), REQUIREMENTS)).otherwise(classified(F.col("text"), EXCEPTIONS))
    return items.withColumn("kind", kind)


def recording_refs(items: DataFrame) -> DataFrame:
    """items(.., text) with recording_ref, what stands after the first label up to a comma, a semicolon or the end of the sentence or line; null without one."""
    return items.withColumn("recording_ref", until(after(F.col("text"), RECORD_LABELS), (",", ";", ". ", "\n")))


def title_risk_score(items: DataFrame) -> DataFrame:
    """(doc, score) of classified items: 10 for each kind of high risk, 2 for other requirements, 1 for other exceptions, 100 at most."""
    points = F.when(F.col("schedule") == "B1", F.when(F.col("kind").isin(*RISKY_REQUIREMENTS), 10).otherwise(2)).otherwise(F.when(F.col("kind").isin(*RISKY_EXCEPTIONS), 10).otherwise(1))
    return items.groupBy("doc").agg(F.least(F.sum(points), F.lit(100).cast("long")).alias("score"))


def parse_field_codes(shots: DataFrame) -> DataFrame:
    """shots(.., raw) to a row for each code: seq, code, number, opens, closes, curve_begins, curve_ends.

    Codes are parted by blanks or commas, text after // is a comment; what is
    no code is left out, seq counting it. A null or blank text gives no rows.
    """
    tokens = F.split(F.trim(F.element_at(F.split("raw", "//", 2), 1)), r"[\s,]+")
    rows = shots.select("*", F.posexplode(tokens).alias("seq", "token")).where(F.col("token").rlike(_CODE))
    part = lambda i: F.upper(F.regexp_extract("token", _CODE, i))
    rows = rows.withColumns({"mark": part(1), "code": part(2), "number": F.nullif(part(3), F.lit("")).cast("long")})
    flags = {"opens": F.col("mark").isin("+", "BEG"), "closes": F.col("mark").isin("-", "END"), "curve_begins": F.col("code") == "BC", "curve_ends": F.col("code").isin("EC", "PT")}
    return rows.withColumns(flags).drop("token", "mark")


def codebook_join(tokens: DataFrame, book: DataFrame, project: DataFrame | None = None) -> DataFrame:
    """tokens(.., code) with kind and layer of book(code, kind, layer); unknown codes are points on FIELD-UNKNOWN.

    A project's own book goes before the general one. A code that one book
    has twice takes its first kind and layer in sort order.
    """
    both = book.select(F.upper("code").alias("code"), "kind", "layer", F.lit(1).alias("rank"))
    if project is not None:
        both = both.unionByName(project.select(F.upper("code").alias("code"), "kind", "layer", F.lit(0).alias("rank")))
    first = both.groupBy("code").agg(F.min(F.struct("rank", "kind", "layer")).alias("entry"))
    joined = tokens.join(first, "code", "left")
    return joined.withColumns({"kind": F.coalesce("entry.kind", F.lit("point")), "layer": F.coalesce("entry.layer", F.lit("FIELD-UNKNOWN"))}).drop("entry")


def feature_runs(tokens: DataFrame) -> DataFrame:
    """(crew, code, number, run, n, begins, ends): the drawn features of tokens(crew, pos, seq, code, number, opens, closes).

    Codes of one crew, name and number in the order of pos and seq make one
    feature until one closes it or the next opens anew; begins and ends are
    the places of its first and last point.
    """
    by = Window.partitionBy("crew", "code", "number").orderBy("pos", "seq")
    fresh = F.col("opens") | F.coalesce(F.lag("closes").over(by), F.lit(False))
    runs = tokens.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("crew", "code", "number", "run").agg(F.count("*").alias("n"), F.min("pos").alias("begins"), F.max("pos").alias("ends"))


def json_from_completion(replies: DataFrame) -> DataFrame:
    """replies(.., text) with json, the text from its first { to its last }, and valid, whether that parses; null without braces."""
    text = F.col("text")
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    body = F.when((first > 0) & (F.locate("}", text) > 0) & (last > first), F.substring(text, first, last - first + 1))
    return replies.withColumn("json", body).withColumn("valid", F.try_parse_json("json").isNotNull())

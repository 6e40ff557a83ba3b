"""Chain-of-title operators over links(parcel, input_pos, deed, grantor, grantee, recorded, instrument)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest gap between consecutive recordings without a remark, in days.
GAP_DAYS = 30 * 365


def normalized_name(name: Column) -> Column:
    """Lower case, without punctuation and suffixes of persons and companies."""
    s = F.regexp_replace(F.lower(F.trim(name)), "[,.]", " ")
    s = F.regexp_replace(s, r"\b(et\s+ux|et\s+vir|et\s+al|jr|sr|iii?|iv|llc|inc|corp)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def grantor_grantee_links(deeds: DataFrame) -> DataFrame:
    """A link for each grantor and grantee of a deed's parties; deeds that lack a side have none."""

    def side(role: str) -> Column:
        return F.transform(F.filter("parties", lambda p: p["role"] == role), lambda p: p["name"])

    others = [c for c in deeds.columns if c != "parties"]
    rows = deeds.withColumn("grantees", side("grantee")).select(*others, "grantees", F.explode(side("grantor")).alias("grantor"))
    return rows.select(*others, "grantor", F.explode("grantees").alias("grantee"))


def _chain(order: list[Column] | None = None) -> Window:
    return Window.partitionBy("parcel").orderBy(*(order or [F.asc_nulls_last("recorded"), F.asc("input_pos")]))


def ordered_chain(links: DataFrame) -> DataFrame:
    """Links with their place in the parcel's chain: by recording date, undated last, then input order."""
    return links.withColumn("place", F.row_number().over(_chain()))


def title_gaps(links: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    """Links recorded more than ``days`` after the one before."""
    gap = F.datediff("recorded", F.lag("recorded").over(_chain()))
    return links.withColumn("gap_days", gap).where(F.col("gap_days") > days)


def duplicate_instruments(links: DataFrame) -> DataFrame:
    """Links whose instrument the parcel has had before, in input order."""
    seen = F.row_number().over(Window.partitionBy("parcel", "instrument").orderBy("input_pos"))
    return links.where("instrument is not null").withColumn("use", seen).where("use > 1")


def wild_deeds(links: DataFrame) -> DataFrame:
    """Links after the first whose grantor had not been a grantee before. Only the first acquisition matters."""
    placed = ordered_chain(links).withColumns({"who": normalized_name(F.col("grantor")), "to": normalized_name(F.col("grantee"))})
    got = placed.groupBy("parcel", F.col("to").alias("who")).agg(F.min("place").alias("since"))
    return placed.join(got, ["parcel", "who"], "left").where("place > 1 and (since is null or since >= place)")


def self_conveyances(links: DataFrame) -> DataFrame:
    return links.where(normalized_name(F.col("grantor")) == normalized_name(F.col("grantee")))


def forks(links: DataFrame) -> DataFrame:
    """(parcel, grantor, grantees): grantors who conveyed to more than one grantee."""
    by = links.groupBy("parcel", normalized_name(F.col("grantor")).alias("grantor"))
    return by.agg(F.countDistinct(normalized_name(F.col("grantee"))).alias("grantees")).where("grantees > 1")


def date_inversions(links: DataFrame) -> DataFrame:
    """Links dated before the grantor's first acquisition anywhere in the chain."""
    named = links.withColumn("who", normalized_name(F.col("grantor")))
    got = links.groupBy("parcel", normalized_name(F.col("grantee")).alias("who")).agg(F.min("recorded").alias("acquired"))
    return named.join(got, ["parcel", "who"]).where("recorded < acquired")


def chain_defect_summary(links: DataFrame) -> DataFrame:
    """(parcel, kind, defects): counts of all kinds, and by ``cube`` their totals (null means all)."""
    kinds = {"gap": title_gaps(links), "duplicate": duplicate_instruments(links), "wild": wild_deeds(links), "self": self_conveyances(links), "fork": forks(links), "inversion": date_inversions(links)}
    rows = None
    for kind, found in kinds.items():
        own = found.select("parcel", F.lit(kind).alias("kind"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.cube("parcel", "kind").agg(F.count("*").alias("defects"))


def upsert_parcels(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """target with the rows of incoming(survey, name, version, ..) in place of those of one survey and name; the latest version counts."""
    latest = Window.partitionBy("survey", "name").orderBy(F.desc_nulls_last("version"))
    new = incoming.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    return target.join(new.select("survey", "name"), ["survey", "name"], "left_anti").unionByName(new)

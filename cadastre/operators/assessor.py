"""Surveyed parcels against the assessor's, and designs against what was built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import rings
from cadastre.operators import fabric
from cadastre.sources.tables import written


def tax_lookup_apn(surveyed: DataFrame, records: DataFrame, counties: DataFrame) -> DataFrame:
    """(id, county, apn, owner, acreage) of surveyed(id, county, apn): the assessor's record, null where there is none.

    counties(county, apn_field, owner_field, acreage_field) name the entries of
    records(county, attrs map<string, string>); it is small and given by the caller.
    """
    named = records.join(counties, "county").select("county", F.element_at("attrs", F.col("apn_field")).alias("apn"), F.element_at("attrs", F.col("owner_field")).alias("owner"), F.element_at("attrs", F.col("acreage_field")).try_cast("double").alias("acreage"))
    return surveyed.join(named.dropDuplicates(["county", "apn"]), ["county", "apn"], "left").select("id", "county", "apn", "owner", "acreage")


def _offset(of, to):
    """Distances of the points of one array to the nearest of another."""
    return F.transform(of, lambda p: F.array_min(F.transform(to, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))


def tax_cross_check(pairs: DataFrame, area_most: float = 0.05, apart_most: float = 5.0) -> DataFrame:
    """(id, ratio, hausdorff, max_offset, passes, notes) of pairs(id, ring, tax_ring), in one metric system.

    ratio: surveyed to assessed area, 0 without an assessed one; max_offset: of
    the surveyed corners from the nearest assessed one.
    """
    own, tax = F.abs(rings.signed_area(F.col("ring"))), F.abs(rings.signed_area(F.col("tax_ring")))
    rows = pairs.select("id", F.when(tax > 0, own / tax).otherwise(0.0).alias("ratio"), fabric.hausdorff(F.col("ring"), F.col("tax_ring")).alias("hausdorff"), F.array_max(_offset("ring", "tax_ring")).alias("max_offset"))
    off = F.abs(F.col("ratio") - 1)
    notes = F.array_compact(F.array(F.when(off > area_most, F.concat(F.lit("area differs by "), F.format_string("%.2f", off * 100), F.lit(" %"))), F.when(F.col("hausdorff") > apart_most, F.concat(F.lit("outlines apart by "), F.format_string("%.2f", "hausdorff"), F.lit(" m")))))
    return rows.withColumns({"passes": (off <= area_most) & (F.col("hausdorff") <= apart_most), "notes": F.array_join(notes, "; ")})


def reconcile_design(designs: DataFrame, built: DataFrame, cell: float, tol: float = 0.05) -> DataFrame:
    """(id, parcel, max_deviation, mean_deviation, hausdorff, passes): each of designs(id, ring) with the built parcel of nearest centre.

    Centres are means of all ring points, the closing one too.  A design looks
    for centres in its cell and the eight around; those that find none within
    a cell's width look again in cells eight times as wide.  Ties go to the
    least parcel; without built parcels there are no rows.
    """

    def centred(rows: DataFrame) -> DataFrame:
        n = F.size("ring")
        mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c]) / n
        return rows.select("id", "ring", mean("x").alias("x"), mean("y").alias("y"))

    d, b = centred(designs), centred(built).select(F.col("id").alias("parcel"), F.col("ring").alias("as_built"), F.col("x").alias("bx"), F.col("y").alias("by"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    away = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    rest, found = d.select("id", "x", "y"), None
    while not b.isEmpty():
        keyed = rest.select("*", around).withColumns({"cx": F.floor(F.col("x") / cell) + F.col("o.i"), "cy": F.floor(F.col("y") / cell) + F.col("o.j")})
        near = keyed.join(b.select("parcel", "bx", "by", F.floor(F.col("bx") / cell).alias("cx"), F.floor(F.col("by") / cell).alias("cy")), ["cx", "cy"])
        # Within one cell's width the nearest centre is among the nine cells.
        own = written(near.where(away <= cell).groupBy("id").agg(F.min(F.struct(away.alias("away"), "parcel")).alias("m")), "nearest")
        found = own if found is None else found.unionByName(own)
        rest = written(rest.join(own, "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
        cell *= 8
    if found is None:
        found = designs.sparkSession.createDataFrame([], f"id {dict(designs.dtypes)['id']}, m struct<away: double, parcel: {dict(built.dtypes)['id']}>")
    pairs = found.select("id", "m.parcel").join(d.select("id", "ring"), "id").join(b.select("parcel", "as_built"), "parcel")
    off = pairs.withColumn("off", _offset("ring", "as_built"))
    most = F.array_max("off")
    return off.select("id", "parcel", most.alias("max_deviation"), (F.aggregate("off", F.lit(0.0), lambda s, v: s + v) / F.size("off")).alias("mean_deviation"), fabric.hausdorff(F.col("ring"), F.col("as_built")).alias("hausdorff"), (most <= tol).alias("passes"))

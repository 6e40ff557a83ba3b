"""Easements: strips along centrelines, their conflicts, and what they take of parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions import rings
from cadastre.operators import spatial

#: Corners of less than this cosine of half their turn are bevelled.
MITER_LEAST = 0.5


def offsets(lines: DataFrame) -> DataFrame:
    """(id, seq, x, y, ox, oy) of lines(id, centerline, width_m): each vertex and the way from it to the strip's left side.

    Corners are mitred; sharp ones bevelled; where the line turns back the first
    segment's normal counts.  The right side lies opposite.
    """
    at = Window.partitionBy("id").orderBy("seq")
    points = lines.where(F.size("centerline") >= 2).select("id", (F.col("width_m") / 2).alias("half"), F.posexplode("centerline").alias("seq", "p")).select("id", "half", "seq", "p.x", "p.y")
    dx, dy = F.lead("x").over(at) - F.col("x"), F.lead("y").over(at) - F.col("y")
    length = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12))
    points = points.withColumns({"nx": -dy / length, "ny": dx / length})
    points = points.withColumns({"bx": F.lag("nx").over(at), "by": F.lag("ny").over(at)})
    sx, sy = F.coalesce("bx", F.lit(0.0)) + F.coalesce("nx", F.lit(0.0)), F.coalesce("by", F.lit(0.0)) + F.coalesce("ny", F.lit(0.0))
    points = points.withColumns({"sx": sx, "sy": sy}).withColumn("norm", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))
    # Of two unit normals, the cosine of half the turn is half the length of their sum.
    cosine = F.col("norm") / 2
    inner = F.col("bx").isNotNull() & F.col("nx").isNotNull()

    def offset(b: str, s: str, n: str) -> Column:
        corner = F.when(F.col("norm") < 1e-12, F.col(b)).when(cosine < MITER_LEAST, F.col(s) / 2).otherwise(F.col(s) / F.col("norm") / cosine)
        return F.col("half") * F.when(inner, corner).otherwise(F.coalesce(n, b))

    return points.select("id", "seq", "x", "y", offset("bx", "sx", "nx").alias("ox"), offset("by", "sy", "ny").alias("oy"))


def easement_strips(lines: DataFrame) -> DataFrame:
    """(id, ring): the closed strip of each of lines(id, centerline, width_m); a line of fewer than two points gives none."""
    corner = lambda sign: F.struct((F.col("x") + sign * F.col("ox")).alias("x"), (F.col("y") + sign * F.col("oy")).alias("y"))
    sides = offsets(lines).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", corner(1.0).alias("left"), corner(-1.0).alias("right")))).alias("s"))
    left, right = F.col("s.left"), F.reverse(F.col("s.right"))
    return sides.select("id", F.concat(left, right, F.slice(left, 1, 1)).alias("ring"))


def segments(lines: DataFrame) -> DataFrame:
    """(id, seq, ring): the strip's part along each segment, as a closed convex ring."""
    at = Window.partitionBy("id").orderBy("seq")
    rows = offsets(lines).withColumns({f"{c}2": F.lead(c).over(at) for c in ("x", "y", "ox", "oy")}).where("x2 is not null")
    corner = lambda n, sign: F.struct((F.col(f"x{n}") + sign * F.col(f"ox{n}")).alias("x"), (F.col(f"y{n}") + sign * F.col(f"oy{n}")).alias("y"))
    return rows.select("id", "seq", F.array(corner("", 1.0), corner("2", 1.0), corner("2", -1.0), corner("", -1.0), corner("", 1.0)).alias("ring"))


def easement_conflicts(lines: DataFrame, cell: float, least: float = 0.01) -> DataFrame:
    """(a, b, area, severity): easements a < b of lines(id, centerline, width_m) that overlap by ``least`` or more.

    Strips are compared segment by segment, each a convex ring; containment
    takes 95 % of the smaller strip, all else is overlap.
    """
    parts = segments(lines)
    keyed = parts.select(F.concat_ws(" ", "id", "seq").alias("id"), F.col("id").alias("owner"), "ring")
    common = spatial.parcel_overlaps(keyed.select("id", "ring"), cell, 0.0)
    owners = keyed.select("id", "owner")
    pairs = common.join(owners.withColumnsRenamed({"id": "a", "owner": "oa"}), "a").join(owners.withColumnsRenamed({"id": "b", "owner": "ob"}), "b").where("oa != ob")
    whole = pairs.groupBy(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b")).agg(F.sum("area").alias("area")).where(F.col("area") >= least)
    sizes = strip_areas(lines).select("id", "area")
    out = whole.join(sizes.withColumnsRenamed({"id": "a", "area": "own"}), "a").join(sizes.withColumnsRenamed({"id": "b", "area": "other"}), "b")
    return out.select("a", "b", "area", F.when(F.col("area") >= 0.95 * F.least("own", "other"), "containment").otherwise("overlap").alias("severity"))


def strip_areas(lines: DataFrame) -> DataFrame:
    """(id, area) of the strips of lines(id, centerline, width_m)."""
    return easement_strips(lines).select("id", F.abs(rings.signed_area(F.col("ring"))).alias("area"))


def encumbered_area(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by.., area): the strips' areas summed by columns of lines; what two strips share counts twice."""
    return lines.select("id", *by).join(strip_areas(lines), "id").groupBy(*by).agg(F.sum("area").alias("area"))


def encumbered_area_net(parcels: DataFrame, lines: DataFrame, cell: float, grid: float) -> DataFrame:
    """(parcel, area): what strips take of parcels(id, ring), shared parts once, by cells of side ``cell`` whose centre they hold.

    An estimate: off by at most the cells along the strips' edges.
    """
    boxes = spatial.with_box(segments(lines)).select("ring", "x0", "y0", "x1", "y1")
    # Strips are dealt by squares of side ``grid``; their centres arise there, so they are told apart and meet the parcels without being sent.
    dealt = spatial.in_cells(boxes, grid).withColumnsRenamed({"cx": "gx", "cy": "gy"}).repartition("gx", "gy")

    def within(low: str, high: str, square: str) -> Column:
        first = F.greatest(F.floor(F.col(low) / cell), F.floor(F.col(square) * grid / cell) - 1)
        last = F.least(F.floor(F.col(high) / cell), F.floor((F.col(square) + 1) * grid / cell) + 1)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    x, y = ((F.col(c) + 0.5) * cell for c in ("cx", "cy"))
    own = (F.floor(x / grid) == F.col("gx")) & (F.floor(y / grid) == F.col("gy")) & (y >= F.col("y0")) & (y < F.col("y1"))
    centres = dealt.withColumn("cx", within("x0", "x1", "gx")).withColumn("cy", within("y0", "y1", "gy")).where(own).where(rings.contains(F.col("ring"), x, y))
    held = centres.select("gx", "gy", "cx", "cy").distinct()
    at = held.select(F.struct("cx", "cy").alias("point"), x.alias("x"), y.alias("y"), F.col("gx").alias("cx"), F.col("gy").alias("cy"))
    found = spatial.placed_in_parcels(at, parcels, grid)
    return found.groupBy("parcel").agg((F.count("*") * cell * cell).alias("area"))

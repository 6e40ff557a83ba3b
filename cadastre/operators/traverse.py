"""Traverse operators over legs(t, seq, az, d): closure, running coordinates, adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions import cogo

#: A closure below this is perfect: its ratio is null.
PERFECT = 1e-6


def _running(columns: tuple[str, ...]) -> Window:
    return Window.partitionBy("t").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def with_components(legs: DataFrame) -> DataFrame:
    return legs.withColumns({"dx": cogo.departure(F.col("az"), F.col("d")), "dy": cogo.latitude(F.col("az"), F.col("d"))})


def traverse_coordinates(legs: DataFrame) -> DataFrame:
    """Legs with the position (x, y) at each leg's end, from the origin."""
    upto = _running(("t",))
    return with_components(legs).withColumns({"x": F.sum("dx").over(upto), "y": F.sum("dy").over(upto)})


def closure_ratio(length: Column, closure: Column) -> Column:
    return length / F.when(closure >= PERFECT, closure)


def traverse_closure(legs: DataFrame) -> DataFrame:
    """(t, n, dx, dy, closure, closure_az, perimeter, ratio, area): one row per traverse.

    One shuffle: the area's running coordinates and the sums share it.
    """
    at = traverse_coordinates(legs)
    # Twice the area is the sum of x1 * y2 - x2 * y1 over the legs; the closing leg to the origin adds nothing.
    cross = (F.col("x") - F.col("dx")) * F.col("y") - F.col("x") * (F.col("y") - F.col("dy"))
    sums = at.groupBy("t").agg(F.count("*").alias("n"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.sum("d").alias("perimeter"), (F.sum(cross) / 2).alias("area"))
    closure, az = cogo.inverse(F.lit(0.0), F.lit(0.0), F.col("dx"), F.col("dy"))
    sums = sums.withColumn("closure", closure)
    return sums.withColumns({"closure_az": F.when(F.col("closure") >= PERFECT, az), "ratio": closure_ratio(F.col("perimeter"), F.col("closure"))})


def area_by_dmd(legs: DataFrame) -> DataFrame:
    """(t, area): DMDs (twice the mid-leg eastings) times latitudes, halved."""
    at = with_components(legs).withColumn("dmd", 2 * F.sum("dx").over(_running(("t",))) - F.col("dx"))
    return at.groupBy("t").agg((F.sum(F.col("dmd") * F.col("dy")) / 2).alias("area"))


def _rebuilt(at: DataFrame) -> DataFrame:
    upto = _running(("t",))
    length, az = cogo.inverse(F.lit(0.0), F.lit(0.0), F.col("adj_dx"), F.col("adj_dy"))
    return at.withColumns({"adj_x": F.sum("adj_dx").over(upto), "adj_y": F.sum("adj_dy").over(upto), "adj_az": az, "adj_d": length})


def adjust_compass(legs: DataFrame) -> DataFrame:
    """Legs with the misclosure spread by length (Bowditch); traverses of zero length are left out."""
    whole = Window.partitionBy("t")
    at = with_components(legs).withColumns({"sum_dx": F.sum("dx").over(whole), "sum_dy": F.sum("dy").over(whole), "length": F.sum("d").over(whole)}).where("length > 0")
    share = F.col("d") / F.col("length")
    return _rebuilt(at.withColumns({"adj_dx": F.col("dx") - F.col("sum_dx") * share, "adj_dy": F.col("dy") - F.col("sum_dy") * share}))


def adjust_transit(legs: DataFrame) -> DataFrame:
    """Legs with the misclosure spread by each axis' own movement; an axis without any stays."""
    whole = Window.partitionBy("t")
    at = with_components(legs)
    at = at.withColumns({"sum_dx": F.sum("dx").over(whole), "sum_dy": F.sum("dy").over(whole), "all_dx": F.sum(F.abs("dx")).over(whole), "all_dy": F.sum(F.abs("dy")).over(whole)})
    adjusted = {f"adj_{c}": F.col(c) - F.when(F.col(f"all_{c}") > 0, F.col(f"sum_{c}") * F.abs(c) / F.col(f"all_{c}")).otherwise(0.0) for c in ("dx", "dy")}
    return _rebuilt(at.withColumns(adjusted))


def classify_closure(closures: DataFrame, standards: dict[str, int] = cogo.STANDARDS) -> DataFrame:
    """A row for each traverse and standard: passes if the ratio is null (perfect) or reaches it."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("standard"), F.lit(r).alias("needed")) for n, r in standards.items()])).alias("s")
    out = closures.select("*", rows).select(*closures.columns, "s.standard", "s.needed")
    return out.withColumn("passes", F.col("ratio").isNull() | (F.col("ratio") >= F.col("needed")))


def closure_report(legs: DataFrame, needed: int = 10_000) -> DataFrame:
    """(t, method, closure, perimeter, passes) unadjusted, by compass and by transit."""

    def row(at: DataFrame, method: str, dx: str, dy: str) -> DataFrame:
        sums = at.groupBy("t").agg(F.sum(dx).alias("dx"), F.sum(dy).alias("dy"), F.sum(F.hypot(dx, dy)).alias("perimeter"))
        closure = F.hypot("dx", "dy")
        return sums.select("t", F.lit(method).alias("method"), closure.alias("closure"), "perimeter", ((closure < PERFECT) | (F.col("perimeter") >= needed * closure)).alias("passes"))

    out = row(with_components(legs), "unadjusted", "dx", "dy")
    return out.unionByName(row(adjust_compass(legs), "compass", "adj_dx", "adj_dy")).unionByName(row(adjust_transit(legs), "transit", "adj_dx", "adj_dy"))


def worst_closures(legs: DataFrame, k: int) -> DataFrame:
    """The k traverses of least ratio (to 9 digits, ties by t): a top-k report."""
    return traverse_closure(legs).where("ratio is not null").orderBy(F.round("ratio", 9), "t").limit(k)

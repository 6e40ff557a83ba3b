"""Field observations: reduction, as-of setups, fusion of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions import cogo

#: Observation kinds that an adjustment can use.
USABLE = ("horizontal_angle", "azimuth", "horizontal_distance", "slope_distance", "height_difference", "gnss")


def usable_observations(obs: DataFrame) -> DataFrame:
    """Observations of usable kinds that nobody rejected."""
    return obs.where(F.col("kind").isin(*USABLE) & ~F.coalesce("rejected", F.lit(False)))


def reduce_observations(setups: DataFrame, obs: DataFrame) -> DataFrame:
    """(setup, target, bearing, horiz, dz) from obs(setup, target, line_no, kind, value, target_height).

    The last record of a kind counts. A horizontal distance wins over a slope
    distance; a target without an angle or without a distance gives no leg.
    A setup without backsight reports the circle reading.
    """
    last = lambda kind, what: F.max_by(F.when(F.col("kind") == kind, what), F.when(F.col("kind") == kind, F.col("line_no")))
    value = F.coalesce("value", F.lit(0.0))
    seen = obs.where("target is not null").groupBy("setup", "target").agg(
        *[last(k, value).alias(k) for k in ("HA", "VA", "SD", "HD")], last("SD", F.coalesce("target_height", F.lit(0.0))).alias("th")
    )
    legs = seen.where("HA is not null and (SD is not null or HD is not null)").join(setups, "setup")
    zenith = F.when(F.col("VA") == 0, F.lit(cogo.TWO_PI / 4)).otherwise(F.col("VA"))
    horiz = F.coalesce("HD", F.col("SD") * F.sin(zenith), "SD")
    dz = F.when(F.col("HD").isNotNull(), 0.0).otherwise(F.coalesce(F.col("SD") * F.cos(zenith), F.lit(0.0)) + F.col("instrument_height") - F.col("th"))
    return legs.select("setup", "target", cogo.azimuth(F.coalesce("backsight", F.lit(0.0)) + F.col("HA")).alias("bearing"), horiz.alias("horiz"), dz.alias("dz"))


def setup_asof(lines: DataFrame) -> DataFrame:
    """Shots of lines(file, pos, kind, station, height), each with the latest earlier station and height of its file."""
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.last(F.when(F.col("kind") == "setup", F.col(c)), ignorenulls=True).over(before)
    return lines.withColumns({"setup": at("station"), "setup_height": at("height")}).where("kind = 'shot'").select("file", "pos", "setup", "setup_height")


def fuse_sources(sources: dict[str, DataFrame], scale: dict[str, float]) -> DataFrame:
    """All sources' rows (id, x, y, z, sigma array) under their names, sigmas times the source's scale (1 if none)."""

    def scaled(name: str) -> DataFrame:
        by = F.lit(scale.get(name, 1.0))
        return sources[name].withColumns({"source": F.lit(name), "sigma": F.transform("sigma", lambda s: s * by)})

    return reduce(DataFrame.unionByName, map(scaled, sources))


def source_counts(fused: DataFrame) -> DataFrame:
    """(network, source, n) with subtotals of each network and of all."""
    return fused.rollup("network", "source").agg(F.count("*").alias("n"))


def measure_path(points: DataFrame) -> DataFrame:
    """points(t, seq, x, y) with the distance and azimuth from the point before, and the length so far."""
    by = Window.partitionBy("t").orderBy("seq")
    d, az = cogo.inverse(F.lag("x").over(by), F.lag("y").over(by), F.col("x"), F.col("y"))
    steps = points.withColumns({"distance": d, "az": az})
    return steps.withColumn("upto", F.coalesce(F.sum("distance").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))

"""Boundary evidence: weights by state rules, weighted determination of corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weight of each kind of evidence by default, and where states differ.
DEFAULT = {
    "natural_monument": 100.0, "artificial_monument_found": 80.0, "court_order": 75.0, "agreement_line": 60.0, "plat_line": 50.0,
    "artificial_monument_record": 40.0, "deed_call_bearing": 25.0, "deed_call_distance": 20.0, "occupation_line": 18.0, "possession_line": 15.0,
    "gnss_observation": 12.0, "adjoiner_deed": 10.0, "tax_map_line": 5.0, "aerial_photo": 4.0, "deed_call_quantity": 2.0,
}
STATES = {
    "CA": {"artificial_monument_found": 95.0, "court_order": 80.0, "plat_line": 55.0, "artificial_monument_record": 35.0, "deed_call_bearing": 22.0, "occupation_line": 15.0, "possession_line": 12.0, "tax_map_line": 4.0, "aerial_photo": 3.0},
    "NY": {"court_order": 80.0, "occupation_line": 65.0, "possession_line": 18.0},
}
KINDS = list(DEFAULT)


def state_rules(spark: SparkSession) -> DataFrame:
    """(state, kind, rule_weight); the state '' holds the defaults."""
    rows = [("", k, w) for k, w in DEFAULT.items()] + [(s, k, w) for s, own in STATES.items() for k, w in (DEFAULT | own).items()]
    return spark.createDataFrame(rows, "state string, kind string, rule_weight double")


def evidence_weights(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Evidence with its rule's weight: the state's own, else the default one, else 1; over sigma squared."""
    own = F.broadcast(rules.select(F.col("state").alias("s"), F.col("kind").alias("k"), F.col("rule_weight").alias("own")))
    default = F.broadcast(rules.where("state = ''").select(F.col("kind").alias("d"), F.col("rule_weight").alias("fallback")))
    out = evidence.join(own, (F.upper("state") == F.col("s")) & (F.col("kind") == F.col("k")), "left").join(default, F.col("kind") == F.col("d"), "left")
    sigma = F.greatest("sigma", F.lit(1e-6))
    return out.withColumn("rule_weight", F.coalesce("own", "fallback", F.lit(1.0))).withColumn("w", F.col("rule_weight") / (sigma * sigma)).select(*evidence.columns, "rule_weight", "w")


def determine_boundary(weighted: DataFrame, k: float = 3.0) -> DataFrame:
    """(corner, n, n_kept, x, y, sigma_x, sigma_y): weighted means, once more without what lies too far off.

    Evidence farther than max(k * weighted rms, k * greatest sigma) from the first mean is rejected, unless that is all of it.
    Sums run in the order of (x, y, w, sigma), so that ties and last digits don't hang on the order of the rows.
    """
    corner = Window.partitionBy("corner")
    rows = weighted.select("corner", "x", "y", "w", F.greatest("sigma", F.lit(1e-6)).alias("sigma"))
    in_order = Window.partitionBy("corner").orderBy("x", "y", "w", "sigma").rowsBetween(Window.unboundedPreceding, 0)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def with_sums(rows: DataFrame, **values) -> DataFrame:
        """The sum of each value over the corner, added up row by row."""
        return rows.withColumns({name: F.sum(value).over(in_order) for name, value in values.items()}).withColumns({name: F.last(name).over(whole) for name in values})

    w, x, y = F.col("w"), F.col("x"), F.col("y")
    rows = with_sums(rows, _w=w, _x=w * x, _y=w * y).withColumns({"_dx": x - F.col("_x") / F.col("_w"), "_dy": y - F.col("_y") / F.col("_w")})
    r = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    rows = with_sums(rows.withColumn("_r", r), _rr=w * F.col("_r") * F.col("_r"))
    rms = F.sqrt(F.col("_rr") / F.col("_w"))
    far = F.greatest(k * F.when(rms > 0, rms).otherwise(1e-6), k * F.max("sigma").over(corner))
    rows = rows.withColumn("keep", F.col("_r") <= far)
    rows = rows.withColumn("keep", F.col("keep") | ~F.max("keep").over(corner))
    rows = rows.withColumn("w", F.when(F.col("keep"), w).otherwise(0.0))
    # Left-out rows add nothing: the order still is that of the first sums but for them.
    rows = with_sums(rows, _w=w, _x=w * x, _y=w * y).withColumns({"fx": F.col("_x") / F.col("_w"), "fy": F.col("_y") / F.col("_w")})
    square = lambda c, m: w * (F.col(c) - F.col(m)) * (F.col(c) - F.col(m))
    rows = with_sums(rows, _sx=square("x", "fx"), _sy=square("y", "fy"))
    spread = lambda c: F.sqrt(F.max(c) / F.greatest(F.max("_w"), F.lit(1e-12)))
    return rows.groupBy("corner").agg(F.count("*").alias("n"), F.sum(F.col("keep").cast("long")).alias("n_kept"), F.max("fx").alias("x"), F.max("fy").alias("y"), spread("_sx").alias("sigma_x"), spread("_sy").alias("sigma_y"))

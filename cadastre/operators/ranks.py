"""Places in an order over all rows, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.sources.tables import written


def ranked(rows: DataFrame, by: str, order: list[str], name: str = "rank") -> DataFrame:
    """rows with ``name``, 0, 1, 2, .. within each value of ``by`` in that order; equal rows stand in any order.

    Rows are dealt into ranges of (by, order) and sorted there, so a large group
    is many ranges; a row's place is its number within the range and what the
    ranges before it hold of its group.  Null is a group of its own.
    """
    sorted_ = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    stood = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_at", 33))
    counts = stood.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_by", "_r", "_first", before.alias("_before"))
    met = stood.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))

"""Connected components of a links table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm.tables import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(k, component): the smallest key reachable, for every key that has a link.

    Each round hangs every key's larger neighbours on its smallest one, then
    its smaller ones; rounds needed grow with the logarithm of the longest
    chain.  Keys with very many links are aggregated map-side.  Self-links and
    repeated links change nothing; no links give no rows.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(hung.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        drop(edges, large)
        edges = new
        roots = edges.select(F.col("v").alias("u")).distinct()
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(roots, "u", "left_semi").isEmpty():
            break
    keys = edges.select(F.col("u").alias("k"), F.col("v").alias("component"))
    return keys.unionByName(edges.select(F.col("v").alias("k"), F.col("v").alias("component")).distinct())

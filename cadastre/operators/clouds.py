"""Point-cloud operators over points(cloud, id, x, y, z, classification)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.operators.ranks import ranked


def cloud_stats(points: DataFrame) -> DataFrame:
    """(cloud, classification, n, extremes): per class; null class is the whole cloud."""
    by = points.rollup("cloud", "classification").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])
    return by.where("cloud is not null")


def cloud_filter_class(points: DataFrame, keep: list[int]) -> DataFrame:
    return points.where(F.col("classification").isin(keep))


def cloud_stride_sample(points: DataFrame, most: int) -> DataFrame:
    """Every n-th point of each cloud in id order, n = count div most: a sampling operator.  A cloud is numbered over many tasks."""
    counts = points.groupBy("cloud").agg(F.count("*").alias("count"))
    stride = F.greatest(F.floor(F.col("count") / most), F.lit(1))
    return ranked(points, "cloud", ["id"]).join(counts, "cloud").where(F.col("rank") % stride == 0).drop("rank", "count")


def voxel_thin(points: DataFrame, cell: float) -> DataFrame:
    """The point nearest the centre of each voxel; ties by id. Aggregated map-side, so dense voxels do no harm."""
    at = {c: F.floor(F.col(c) / cell) for c in "xyz"}
    off = sum((F.col(c) - (at[c] + 0.5) * cell) * (F.col(c) - (at[c] + 0.5) * cell) for c in "xyz")
    best = F.min(F.struct(F.round(off, 9).alias("off"), "id", "x", "y", "z", "classification"))
    return points.groupBy("cloud", *[v.alias(f"v{c}") for c, v in at.items()]).agg(best.alias("p")).select("cloud", "p.id", "p.x", "p.y", "p.z", "p.classification")


def dem_idw(points: DataFrame, cell: float, power: int = 2) -> DataFrame:
    """(cloud, cx, cy, z): inverse-distance mean at each cell's centre of the points in it and its eight neighbours."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = points.withColumn("o", around)
    spread = spread.withColumns({"cx": F.floor(F.col("x") / cell) + F.col("o.i"), "cy": F.floor(F.col("y") / cell) + F.col("o.j")})
    d = F.hypot(F.col("x") - (F.col("cx") + 0.5) * cell, F.col("y") - (F.col("cy") + 0.5) * cell)
    w = 1 / F.pow(F.greatest(d, F.lit(1e-6)), power)
    return spread.groupBy("cloud", "cx", "cy").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("z"))


def grid_tin(dem: DataFrame) -> DataFrame:
    """Two triangles for each four neighbouring cells of a raster: (cloud, cx, cy, half, z1, z2, z3)."""
    at = lambda i, j, z: dem.select("cloud", (F.col("cx") - i).alias("cx"), (F.col("cy") - j).alias("cy"), F.col("z").alias(z))
    square = at(0, 0, "za").join(at(1, 0, "zb"), ["cloud", "cx", "cy"]).join(at(0, 1, "zc"), ["cloud", "cx", "cy"]).join(at(1, 1, "zd"), ["cloud", "cx", "cy"])
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("za").alias("z1"), F.col("zb").alias("z2"), F.col("zd").alias("z3")), F.struct(F.lit(1).alias("half"), F.col("za").alias("z1"), F.col("zd").alias("z2"), F.col("zc").alias("z3"))))
    return square.select("cloud", "cx", "cy", halves.alias("t")).select("cloud", "cx", "cy", "t.*")


def residual_stats(rows: DataFrame, value: str, by: str, z: float = 1.959964) -> DataFrame:
    """(by, n, rms, std, mse, lo, hi): std is 0 for one row; lo and hi bound the mean."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    half = z * std / F.sqrt(F.count("*"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), std.alias("std"), F.avg(F.col(value) * F.col(value)).alias("mse"), (F.avg(value) - half).alias("lo"), (F.avg(value) + half).alias("hi"))

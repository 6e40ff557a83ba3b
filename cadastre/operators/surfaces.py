"""Surfaces from point clouds: ground filters, triangles, interpolation and contours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.operators.clouds import dem_idw, voxel_thin
from cadastre.operators.graphs import components


def _opened(grid: DataFrame, size: int) -> DataFrame:
    """grid(cloud, cx, cy, z, ..) with ``opened``: the least, then the greatest z within ``size`` cells each way.

    Rows first, then columns: both are sliding windows over cells that exist.
    """
    along = lambda line, at: Window.partitionBy("cloud", line).orderBy(at).rangeBetween(-size, size)
    low = grid.withColumn("m", F.min("z").over(along("cy", "cx"))).withColumn("m", F.min("m").over(along("cx", "cy")))
    return low.withColumn("m", F.max("m").over(along("cy", "cx"))).withColumn("opened", F.max("m").over(along("cx", "cy"))).drop("m")


def _lowest(points: DataFrame, cell: float) -> DataFrame:
    return points.groupBy("cloud", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.min("z").alias("z"))


def _judged(points: DataFrame, surface: DataFrame, cell: float, threshold: float) -> DataFrame:
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return at.join(surface, ["cloud", "cx", "cy"]).withColumn("ground", F.col("z") - F.col("surface") <= threshold).drop("cx", "cy", "surface")


def classify_ground_smrf(points: DataFrame, cell: float = 1.0, slope: float = 0.15, threshold: float = 0.5, window: float = 18.0) -> DataFrame:
    """points(cloud, x, y, z, ..) with ``ground``, by openings of growing size of the lowest points' grid.

    A cell that an opening of radius k lowers by more than slope * k * cell is
    an object; the surface under it is the last opening's.  A point is ground
    if it stands at most ``threshold`` above its cell's surface.
    """
    grid = _lowest(points, cell).withColumn("object", F.lit(False))
    now = grid.withColumn("low", F.col("z"))
    for size in range(1, max(1, int(window / cell / 2)) + 1):
        now = _opened(now, size)
        now = now.withColumn("object", F.col("object") | (F.col("z") - F.col("opened") > slope * size * cell)).withColumn("z", F.col("opened")).drop("opened")
    surface = now.select("cloud", "cx", "cy", F.when(F.col("object"), F.col("z")).otherwise(F.col("low")).alias("surface"))
    return _judged(points, surface, cell, threshold)


def classify_ground_pmf(points: DataFrame, cell: float = 1.0, slope: float = 1.0, first: float = 0.15, most: float = 2.5, window: int = 8) -> DataFrame:
    """points(cloud, x, y, z, ..) with ``ground``: progressive morphological filter with windows 1, 2, 4, .. cells.

    A cell is cut down to its opening where it rises by more than the step's
    threshold: ``first``, then slope times the growth of the window, at most ``most``.
    """
    now, size, before, threshold = _lowest(points, cell), 1, 0, first
    while size <= window:
        now = _opened(now, size)
        now = now.withColumn("z", F.when(F.col("z") - F.col("opened") > threshold, F.col("opened")).otherwise(F.col("z"))).drop("opened")
        before, size = size, 2 * size
        threshold = min(most, slope * (size - before) * cell + first)
    return _judged(points, now.withColumnRenamed("z", "surface"), cell, first)


def raster_triangles(tin: DataFrame, cell: float) -> DataFrame:
    """(cloud, tri, a, b, c) with struct<x, y, z> corners from grid_tin's halves of cells."""
    corner = lambda i, j, z: F.struct(((F.col("cx") + i + 0.5) * cell).alias("x"), ((F.col("cy") + j + 0.5) * cell).alias("y"), F.col(z).alias("z"))
    second, third = F.when(F.col("half") == 0, corner(1, 0, "z2")).otherwise(corner(1, 1, "z2")), F.when(F.col("half") == 0, corner(1, 1, "z3")).otherwise(corner(0, 1, "z3"))
    return tin.select("cloud", F.concat_ws(" ", "cx", "cy", "half").alias("tri"), corner(0, 0, "z1").alias("a"), second.alias("b"), third.alias("c"))


def tin_interpolate(triangles: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """(cloud, id, z): height of points(cloud, id, x, y) on triangles(cloud, tri, a, b, c); null outside.

    Triangles stand in all cells that their boxes touch.  On a common side the
    least triangle counts.
    """
    over = lambda c: [F.col(f"{v}.{c}") for v in "abc"]
    box = triangles.withColumns({"x0": F.floor(F.least(*over("x")) / cell), "x1": F.floor(F.greatest(*over("x")) / cell), "y0": F.floor(F.least(*over("y")) / cell), "y1": F.floor(F.greatest(*over("y")) / cell)})
    cells = box.select("cloud", "tri", "a", "b", "c", F.explode(F.sequence("x0", "x1")).alias("cx"), "y0", "y1").select("cloud", "tri", "a", "b", "c", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    at = points.select("cloud", "id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    met = at.join(cells, ["cloud", "cx", "cy"])
    det = F.expr("(b.y - c.y) * (a.x - c.x) + (c.x - b.x) * (a.y - c.y)")
    u, v = F.expr("(b.y - c.y) * (x - c.x) + (c.x - b.x) * (y - c.y)") / det, F.expr("(c.y - a.y) * (x - c.x) + (a.x - c.x) * (y - c.y)") / det
    met = met.withColumns({"u": u, "v": v}).where("u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9")
    found = met.groupBy("cloud", "id", "x", "y").agg(F.min(F.struct("tri", F.expr("u * a.z + v * b.z + (1 - u - v) * c.z").alias("z"))).alias("m"))
    return points.select("cloud", "id", "x", "y").join(found, ["cloud", "id", "x", "y"], "left").select("cloud", "id", "m.z")


def contour_segments(triangles: DataFrame, interval: float) -> DataFrame:
    """(cloud, elev, tri, p, q): where each triangle crosses the levels that are multiples of ``interval``; corners at a level count as below it."""
    z = [F.col(f"{v}.z") for v in "abc"]
    lo, hi = F.ceil(F.least(*z) / interval), F.floor(F.greatest(*z) / interval)
    rows = triangles.where(lo <= hi).select("cloud", "tri", "a", "b", "c", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * interval)).alias("elev"))
    above = [F.col(f"{v}.z") > F.col("elev") for v in "abc"]
    n = sum(x.cast("int") for x in above)
    odd = lambda i: F.when(n == 1, above[i]).otherwise(~above[i])
    rows = rows.where(n.between(1, 2))
    order = lambda i: F.array(*[F.col("abc"[(i + k) % 3]) for k in range(3)])
    rows = rows.withColumn("v", F.when(odd(0), order(0)).when(odd(1), order(1)).otherwise(order(2)))

    def cross(i: int) -> Column:
        p, q = F.col("v")[0], F.col("v")[i]
        t = F.least(F.greatest(F.try_divide(F.col("elev") - p["z"], q["z"] - p["z"]), F.lit(0.0)), F.lit(1.0))
        return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

    return rows.select("cloud", "elev", "tri", cross(1).alias("p"), cross(2).alias("q"))


def contour_index_flag(contours: DataFrame, interval: float, every: int = 5) -> DataFrame:
    """contours(.., elev) with ``index``: whether the level is an ``every``-th one."""
    return contours.withColumn("index", F.pmod(F.round(F.col("elev") / interval).cast("long"), F.lit(every)) == 0)


def _walk(rows: pa.Table) -> pa.Table:
    """Segments (cloud, elev, chain, px, py, qx, qy) of one chain to its points in walking order."""
    ends = np.stack([np.stack([rows[f"{e}x"].to_numpy(), rows[f"{e}y"].to_numpy()], 1) for e in "pq"], 1)
    places, number = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    number = number.reshape(-1, 2)
    at: dict[int, list[int]] = {}
    for s, (p, q) in enumerate(number.tolist()):
        at.setdefault(p, []).append(s)
        at.setdefault(q, []).append(s)
    ones = [v for v, s in at.items() if len(s) == 1]
    here, used = min(ones or at), np.zeros(len(number), dtype=bool)
    order = [here]
    while (step := next((s for s in at[here] if not used[s]), None)) is not None:
        used[step] = True
        here = int(number[step][0] + number[step][1] - here)
        order.append(here)
    line = places[order]
    head = rows.slice(0, 1)
    return pa.table({"cloud": head["cloud"], "elev": head["elev"], "chain": head["chain"], "line": pa.array([[{"x": float(x), "y": float(y)} for x, y in line]], type=pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})


def contour_chains(segments: DataFrame, digits: int = 6) -> DataFrame:
    """(cloud, elev, chain, line): segments(cloud, elev, p, q) joined where their ends, rounded, meet.

    A chain is a connected component of one level; its line starts at a loose
    end, or at the least point of a closed one.  Where more than two segments
    meet, the walk takes one of them.
    """
    key = lambda e: F.concat_ws(" ", "cloud", "elev", F.round(F.col(f"{e}.x"), digits) + 0.0, F.round(F.col(f"{e}.y"), digits) + 0.0)
    rows = segments.select("cloud", "elev", *[(F.round(F.col(f"{e}.{c}"), digits) + 0.0).alias(f"{e}{c}") for e in "pq" for c in "xy"], key("p").alias("pk"), key("q").alias("qk")).where("pk != qk").distinct()
    chains = components(rows.select(F.col("pk").alias("a"), F.col("qk").alias("b")))
    joined = rows.join(chains.withColumnsRenamed({"id": "pk", "component": "chain"}), "pk").select("cloud", "elev", "chain", "px", "py", "qx", "qy")
    kind = dict(segments.dtypes)["cloud"]
    return joined.groupBy("cloud", "elev", "chain").applyInArrow(_walk, f"cloud {kind}, elev double, chain string, line array<struct<x: double, y: double>>")


def _delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (indices) of distinct points, by inserting one after the other into the triangles whose circle holds it."""
    centre, span = points.mean(axis=0), max(np.ptp(points, axis=0).max(), 1.0)
    all_points = np.vstack([points, centre + span * np.array([[-30.0, -20.0], [30.0, -20.0], [0.0, 40.0]])])
    n = len(points)
    tri, circle = np.array([[n, n + 1, n + 2]]), np.array([[*centre, (100 * span) ** 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = (all_points[t[:, i]] - centre for i in range(3))
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        a2, b2, c2 = ((v * v).sum(axis=1) for v in (a, b, c))
        x = (a2 * (b[:, 1] - c[:, 1]) + b2 * (c[:, 1] - a[:, 1]) + c2 * (a[:, 1] - b[:, 1])) / d
        y = (a2 * (c[:, 0] - b[:, 0]) + b2 * (a[:, 0] - c[:, 0]) + c2 * (b[:, 0] - a[:, 0])) / d
        return np.stack([x + centre[0], y + centre[1], (a[:, 0] - x) ** 2 + (a[:, 1] - y) ** 2], 1)

    for i in np.lexsort((points[:, 1], points[:, 0])):
        p = points[i]
        bad = (circle[:, 0] - p[0]) ** 2 + (circle[:, 1] - p[1]) ** 2 < circle[:, 2] * (1 - 1e-12)
        sides = tri[bad][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2)
        code = np.sort(sides, axis=1)
        _, first, times = np.unique(code, axis=0, return_index=True, return_counts=True)
        outer = sides[first[times == 1]]
        new = np.column_stack([outer, np.full(len(outer), i)])
        tri, circle = np.vstack([tri[~bad], new]), np.vstack([circle[~bad], circles(new)])
    return tri[(tri < n).all(axis=1)]


def tin_tiles(points: DataFrame, tile: float, halo: float) -> DataFrame:
    """(cloud, tri, a, b, c): Delaunay triangles of points(cloud, x, y, z), tile by tile.

    A tile sees the points up to ``halo`` beyond it and keeps the triangles
    whose centre it holds.  Points of one place are one, the lowest.  Thin dense
    clouds first: a tile's points are triangulated in one task.
    """
    places = points.groupBy("cloud", "x", "y").agg(F.min("z").alias("z"))
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    spread = places.select("cloud", "x", "y", "z", F.explode(near("x")).alias("tx"))
    spread = spread.select("cloud", "x", "y", "z", "tx", F.explode(near("y")).alias("ty"))

    def run(rows: pa.Table) -> pa.Table:
        xyz = np.stack([rows[c].to_numpy() for c in "xyz"], 1)
        tx, ty = rows["tx"][0].as_py(), rows["ty"][0].as_py()
        found = _delaunay(xyz[:, :2]) if len(xyz) >= 3 else np.empty((0, 3), dtype=np.int64)
        middle = xyz[found][:, :, :2].mean(axis=1) if len(found) else np.empty((0, 2))
        found = found[(np.floor(middle[:, 0] / tile) == tx) & (np.floor(middle[:, 1] / tile) == ty)]
        corner = [pa.StructArray.from_arrays([pa.array(xyz[found[:, i], k]) for k in range(3)], names=["x", "y", "z"]) for i in range(3)]
        cloud = pa.concat_arrays([rows["cloud"].slice(0, 1).combine_chunks()] * len(found)) if len(found) else rows["cloud"].slice(0, 0).combine_chunks()
        return pa.table({"cloud": cloud, "tri": pa.array([f"{tx} {ty} {i}" for i in range(len(found))], type=pa.string()), **dict(zip("abc", corner, strict=True))})

    kind, corner = dict(points.dtypes)["cloud"], "struct<x: double, y: double, z: double>"
    return spread.groupBy("cloud", "tx", "ty").applyInArrow(run, f"cloud {kind}, tri string, a {corner}, b {corner}, c {corner}")


def surface_pipeline(points: DataFrame, cell: float, tile: float, halo: float, interval: float, **ground) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triangles, contours and raster of the ground of points(cloud, id, x, y, z, classification): filtered, thinned to ``cell``, triangulated."""
    low = classify_ground_smrf(points, **ground).where("ground").drop("ground")
    thin = voxel_thin(low, cell)
    triangles = tin_tiles(thin, tile, halo)
    return triangles, contour_chains(contour_segments(triangles, interval)), dem_idw(thin, cell)

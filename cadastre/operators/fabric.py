"""Parcel fabric: shared edges, adjacency, removal and dissolving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fabric_edges(parcels: DataFrame, tol: float) -> DataFrame:
    """(id, seq, edge): the sides of parcels(id, ring); parcels sharing a side share its edge.

    An edge is the pair of its ends on a grid of ``tol``, smaller end first.
    Sides that collapse on the grid are left out.
    """
    node = lambda p: F.struct(F.round(p["x"] / tol).cast("long").alias("x"), F.round(p["y"] / tol).cast("long").alias("y"))
    ends = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(node(F.get("ring", i - 1)).alias("p"), node(F.get("ring", i)).alias("q")))
    sides = parcels.select("id", F.posexplode(ends).alias("seq", "s")).where("s.p != s.q")
    return sides.select("id", "seq", F.struct(F.least("s.p", "s.q").alias("p"), F.greatest("s.p", "s.q").alias("q")).alias("edge"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, shared): parcels a < b with the number of edges that both use."""
    other = edges.select(F.col("id").alias("b"), "edge")
    return edges.select(F.col("id").alias("a"), "edge").join(other, "edge").where("a < b").groupBy("a", "b").agg(F.countDistinct("edge").alias("shared"))


def remove_parcels(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The sides left once the parcels of ids(id) are gone."""
    return edges.join(ids, "id", "left_anti")


def gc_orphans(used: DataFrame, known: DataFrame) -> DataFrame:
    """Those of known(edge) that a side still uses."""
    return known.join(used.select("edge"), "edge", "left_semi")


def merge_outline(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, edge): outer edges of each group of groups(id, grp), those that one parcel of the group uses."""
    return edges.join(groups, "id").groupBy("grp", "edge").count().where(F.col("count") == 1).select("grp", "edge")


def hausdorff(a: Column, b: Column) -> Column:
    """Symmetric Hausdorff distance of two arrays of struct(x, y)."""

    def reach(of: Column, to: Column) -> Column:
        return F.array_max(F.transform(of, lambda p: F.array_min(F.transform(to, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))))

    return F.greatest(reach(a, b), reach(b, a))


def feature_summary(features: DataFrame) -> DataFrame:
    """(file, n, layers, x0, y0, x1, y1) of features(file, layer, x, y)."""
    bounds = [f(c).alias(c + e) for e, f in (("0", F.min), ("1", F.max)) for c in ("x", "y")]
    return features.groupBy("file").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("layer")).alias("layers"), *bounds)


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """(file, warning, pos): each warning of a file once, at its first position."""
    return warnings.groupBy("file", "warning").agg(F.min("pos").alias("pos"))


#: Controls that stand in one row beside a node.
CONTROLS = 1000


def move_nodes(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """nodes(id, x, y) with the places of moves(id, x, y) for those it names."""
    to = moves.select("id", F.struct("x", "y").alias("to"))
    return nodes.join(to, "id", "left").select("id", F.coalesce("to.x", "x").alias("x"), F.coalesce("to.y", "y").alias("y"))


def rubber_sheet(nodes: DataFrame, controls: DataFrame, power: float = 2.0, eps: float = 1e-9) -> DataFrame:
    """nodes(id, x, y) moved by the mean of what controls(ord, sx, sy, tx, ty) move, weighted by distance to -power.

    A node within ``eps`` of a control goes to the target of the first such
    one; without controls nothing moves.  Controls are dealt into blocks, every
    node meets each block once, and the blocks' sums are added.
    """
    if power <= 0:
        raise ValueError("power must be above 0")
    blocks = controls.withColumn("n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("ord"), F.lit(64))).orderBy("ord"))).groupBy(F.concat_ws(" ", F.pmod(F.xxhash64("ord"), F.lit(64)), F.floor(F.col("n") / CONTROLS)).alias("block"))
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("ord", "sx", "sy", "tx", "ty"))).alias("controls"))
    names = blocks.agg(F.collect_list("block").alias("names"))  # one short name for each block

    def apart(c: Column) -> Column:
        return F.hypot(F.col("x") - c["sx"], F.col("y") - c["sy"])

    def add(total: Column, c: Column) -> Column:
        weight = F.pow(F.greatest(apart(c), F.lit(eps)), F.lit(-power))
        return F.struct((total["w"] + weight).alias("w"), (total["x"] + weight * (c["tx"] - c["sx"])).alias("x"), (total["y"] + weight * (c["ty"] - c["sy"])).alias("y"))

    none = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "x", "y")])
    pinned = F.get(F.filter("controls", lambda c: apart(c) <= eps), F.lit(0))
    met = nodes.crossJoin(F.broadcast(names)).select("id", "x", "y", F.explode("names").alias("block")).join(blocks, "block").withColumns({"pin": pinned, "sum": F.aggregate("controls", none, add)})
    sums = met.groupBy("id").agg(F.min("pin").alias("pin"), F.sum("sum.w").alias("w"), F.sum("sum.x").alias("mx"), F.sum("sum.y").alias("my"))
    moved = nodes.join(sums, "id", "left")
    place = lambda c: F.when(F.col("pin").isNotNull(), F.col(f"pin.t{c}")).when(F.col("w") > 0, F.col(c) + F.col(f"m{c}") / F.col("w")).otherwise(F.col(c)).alias(c)
    return moved.select("id", place("x"), place("y"))


def fabric_rings(edges: DataFrame, tol: float) -> DataFrame:
    """(id, ring): the closed rings that fabric_edges were taken from, on its grid. A ring of fewer than three edges gives none."""
    sides = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "edge"))).alias("sides")).where(F.size("sides") >= 3)

    def start(side: Column, i: Column) -> Column:
        before = F.element_at("sides", F.when(i == 0, F.lit(-1)).otherwise(i))["edge"]
        p, q = side["edge"]["p"], side["edge"]["q"]
        node = F.when((p == before["p"]) | (p == before["q"]), p).otherwise(q)
        return F.struct((node["x"] * tol).alias("x"), (node["y"] * tol).alias("y"))

    ring = sides.select("id", F.transform("sides", start).alias("ring"))
    return ring.select("id", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))

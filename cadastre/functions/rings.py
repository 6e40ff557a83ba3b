"""Rings as arrays of struct<x, y>: metrics, orientation and clipping, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """struct<a, b> of each edge of a closed ring."""
    return F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def closed(ring: Column) -> Column:
    """The ring with its first point at the end too."""
    return F.when(F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def signed_area(ring: Column) -> Column:
    """Shoelace area about the first point; positive if counter-clockwise."""
    def about(k: Column) -> Column:
        return _sum(F.transform(edges(k["r"]), lambda e: (e["a"]["x"] - k["o"]["x"]) * (e["b"]["y"] - k["o"]["y"]) - (e["b"]["x"] - k["o"]["x"]) * (e["a"]["y"] - k["o"]["y"]))) / 2

    return let(ring, lambda r: let(F.struct(r.alias("r"), F.try_element_at(r, F.lit(1)).alias("o")), about))


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of the corners, the closing point left out."""
    corners = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    return _sum(F.transform(corners, lambda p: p["x"])) / F.size(corners), _sum(F.transform(corners, lambda p: p["y"])) / F.size(corners)


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Least x, least y, greatest x, greatest y."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def oriented(ring: Column, counter_clockwise: bool = True) -> Column:
    area = signed_area(ring)
    return F.when(area < 0 if counter_clockwise else area > 0, F.reverse(ring)).otherwise(ring)


def valid(ring: Column) -> Column:
    """At least four points, and closed."""
    return (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def is_box(ring: Column) -> Column:
    """Whether a closed ring is its own bounding box: four sides along the axes in turn, and no NaN."""
    def test(r: Column) -> Column:
        p = [F.get(r, F.lit(i)) for i in range(5)]
        same = lambda axis, i, j: p[i][axis] == p[j][axis]
        across_first = same("y", 0, 1) & same("x", 1, 2) & same("y", 2, 3) & same("x", 3, 0)
        up_first = same("x", 0, 1) & same("y", 1, 2) & same("x", 2, 3) & same("y", 3, 0)
        return (F.size(r) == 5) & same("x", 0, 4) & same("y", 0, 4) & (across_first | up_first) & ~F.isnan(p[0]["x"] + p[0]["y"] + p[2]["x"] + p[2]["y"])

    # The ring stands in it once, as filters repeat what it is made from.
    return F.coalesce(let(ring, test), F.lit(False))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting."""
    # By place in the ring: no list of edges is made for each point.
    def crosses(b: Column, i: Column) -> Column:
        a = F.get(ring, i - 1)
        return (i > 0) & ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.pmod(F.size(F.filter(ring, crosses)), F.lit(2)) == 1


def cut(subject: Column, lines: Column) -> Column:
    """The part of a ring left of all lines through two points (array<struct<a, b>>), cut by one after the other."""

    def inside(e: Column, p: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])

    def half(poly: Column, e: Column) -> Column:
        sides = F.transform(let(poly, edges), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), inside(e, s["a"]).alias("p"), inside(e, s["b"]).alias("q")))
        kept = F.filter(sides, lambda s: (s["p"] >= 0) | (s["q"] >= 0))

        def of(s: Column) -> Column:
            t = s["p"] / (s["p"] - s["q"])
            cross = F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))
            end = F.struct(s["b"]["x"].alias("x"), s["b"]["y"].alias("y"))
            return F.when(s["q"] < 0, F.array(cross)).when(s["p"] < 0, F.array(cross, end)).otherwise(F.array(end))

        return let(F.flatten(F.transform(kept, of)), lambda new: F.concat(new, F.slice(new, 1, 1)))

    return F.aggregate(lines, subject, half)


def clip(subject: Column, window: Column) -> Column:
    """Sutherland-Hodgman: the part of a ring inside a convex ring; both are made counter-clockwise first."""
    return cut(oriented(subject), edges(oriented(window)))


def set_back(ring: Column, distance) -> Column:
    """A convex ring with each edge moved inwards by distance(edge); empty where nothing is left."""

    def moved(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        by = distance(e) / F.hypot(dx, dy)
        end = lambda p: F.struct((p["x"] - by * dy).alias("x"), (p["y"] + by * dx).alias("y"))
        return F.struct(end(e["a"]).alias("a"), end(e["b"]).alias("b"))

    lengthy = lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"])
    return let(oriented(closed(ring)), lambda r: cut(r, F.transform(F.filter(edges(r), lengthy), moved)))


def wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))

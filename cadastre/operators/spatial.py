"""Joins of parcels and points by cells: equi-joins, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions import rings


#: Triangles of concave rings clipped at once.
TRIANGLES = 1 << 14


def in_cells(boxes: DataFrame, cell: float, columns: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """A row for each cell that a box touches: cx, cy."""
    x0, y0, x1, y1 = (F.floor(F.col(c) / cell) for c in columns)
    return boxes.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))


def with_box(parcels: DataFrame, ring: str = "ring") -> DataFrame:
    return parcels.withColumns(dict(zip(("x0", "y0", "x1", "y1"), rings.bounds(F.col(ring)), strict=True)))


def _measures(rings_of: pa.ListArray) -> tuple[list[pa.Array], np.ndarray]:
    """Least and greatest x and y of rings, as rings.bounds() has them, and which rings are boxes, as rings.is_box() has it."""
    at, points = rings_of.offsets.to_numpy().astype(np.int64), rings_of.values
    size = np.where(rings_of.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    known = points.is_valid()
    x, y = (pc.if_else(known, points.field(c).cast(pa.float64()), None) for c in ("x", "y"))
    filled = np.flatnonzero(size > 0)
    ends = np.stack((at[filled], at[filled] + size[filled]), 1).ravel()

    def bound(v: pa.Array, by: np.ufunc, blank: float) -> pa.Array:
        """Nulls don't count; NaN is above all numbers."""
        given, values = v.is_valid().to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)
        # The last end lies behind all values.
        found, some = np.full(len(size), np.nan), np.zeros(len(size), dtype=bool)
        found[filled] = by.reduceat(np.append(np.where(given, values, blank), blank), ends)[::2] if len(filled) else ()
        some[filled] = np.logical_or.reduceat(np.append(given, False), ends)[::2] if len(filled) else ()
        return pa.array(found, mask=~some)

    bounds = [bound(v, by, blank) for by, blank in ((np.fmin, np.nan), (np.maximum, -np.inf)) for v in (x, y)]
    is_box, five = np.zeros(len(size), dtype=bool), np.flatnonzero(size == 5)
    (x0, x1, x2, x3, x4), (y0, y1, y2, y3, y4) = (v.to_numpy(zero_copy_only=False)[at[five][:, None] + np.arange(5)].T for v in (x, y))
    across_first, up_first = (y0 == y1) & (x1 == x2) & (y2 == y3) & (x3 == x0), (x0 == x1) & (y1 == y2) & (x2 == x3) & (y3 == y0)
    is_box[five] = (x0 == x4) & (y0 == y4) & (across_first | up_first)
    return bounds, is_box


def boxed(parcels: DataFrame, box: bool | None = None) -> DataFrame:
    """Rows of an id and a ring with x0, y0, x1, y1 of the ring; all, or with ``box`` those whose ring is a box, without the ring, or isn't one.

    In Arrow batches: as expressions, what a ring is made from would be repeated for every use of its bounds.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, is_box = _measures(batch.column(1))
            own = batch.columns[:1] if box else batch.columns
            rows = pa.RecordBatch.from_arrays([*own, *bounds], names=[*batch.schema.names[: len(own)], "x0", "y0", "x1", "y1"])
            yield rows if box is None else rows.filter(pa.array(is_box == box))

    kept = parcels.select(parcels.columns[0]) if box else parcels
    return parcels.mapInArrow(measured, kept.select("*", *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).schema)


def boxes_apart(parcels: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """In their cells, the parcels whose rings are boxes, without their rings, and the others."""
    return in_cells(boxed(parcels, True), cell), in_cells(boxed(parcels, False), cell)


def _corners(rings_of: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, n): counter-clockwise corners of closed rings, a row each, padded; the closing point is left out."""
    at, points = rings_of.offsets.to_numpy(), rings_of.values
    n = np.maximum(np.diff(at) - 1, 0)
    place = at[:-1, None] + np.minimum(np.arange(max(n.max(initial=0), 1)), np.maximum(n - 1, 0)[:, None])
    x, y = (points.field(c).to_numpy()[place] for c in ("x", "y"))
    turned = areas(x, y, n) < 0
    order = np.where(turned[:, None], np.maximum(n[:, None] - 1 - np.arange(x.shape[1]), 0), np.arange(x.shape[1]))
    return np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1), n


def areas(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed areas of padded corner rows, about each first corner."""
    i = np.arange(x.shape[1])
    after = np.where(i + 1 < n[:, None], i + 1, 0)
    dx, dy = x - x[:, :1], y - y[:, :1]
    cross = dx * np.take_along_axis(dy, after, 1) - np.take_along_axis(dx, after, 1) * dy
    return np.where(i < n[:, None], cross, 0).sum(axis=1) / 2


def cut(x, y, n, ax, ay, bx, by, active):
    """All rings cut at once by one edge each: the part left of a-b; rings that aren't ``active`` stay."""
    i = np.arange(x.shape[1])
    after = np.where(i + 1 < n[:, None], i + 1, 0)
    side = np.where(active[:, None], (bx - ax)[:, None] * (y - ay[:, None]) - (by - ay)[:, None] * (x - ax[:, None]), 0.0)
    x2, y2, side2 = (np.take_along_axis(v, after, 1) for v in (x, y, side))
    real = i < n[:, None]
    crossing, end = real & ((side >= 0) != (side2 >= 0)), real & (side2 >= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = side / (side - side2)
        new_x, new_y = np.stack((x + t * (x2 - x), x2), 2), np.stack((y + t * (y2 - y), y2), 2)
    keep = np.stack((crossing, end), 2).reshape(len(x), -1)
    count = keep.sum(axis=1)
    out_x, out_y = (np.zeros((len(x), max(count.max(initial=0), 1))) for _ in range(2))
    row, column = np.nonzero(keep)
    place = (np.cumsum(keep, axis=1) - 1)[row, column]
    out_x[row, place], out_y[row, place] = new_x.reshape(len(x), -1)[row, column], new_y.reshape(len(x), -1)[row, column]
    return out_x, out_y, count


def _convex(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether padded counter-clockwise corner rows turn left all the way, straight corners allowed."""
    i = np.arange(x.shape[1])
    ahead = lambda k: np.where(i + k < n[:, None], i + k, np.maximum(i + k - n[:, None], 0)) % x.shape[1]
    (x1, y1), (x2, y2) = [[np.take_along_axis(v, ahead(k), 1) for v in (x, y)] for k in (1, 2)]
    turn = (x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1)
    return ((turn >= 0) | (i >= n[:, None])).all(axis=1)


def _clipped(x, y, n, wx, wy, wn) -> np.ndarray:
    """Signed areas of what any simple rings have within convex windows, row by row; the bridges along which a cut concave ring hangs together have no area."""
    rows = np.arange(len(wn))
    for e in range(wx.shape[1]):
        after = np.where(e + 1 < wn, e + 1, 0)
        x, y, n = cut(x, y, n, wx[:, e], wy[:, e], wx[rows, after], wy[rows, after], e < wn)
    return areas(x, y, n)


def _fans(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y, sign): the triangles between each ring's first corner and its sides, counter-clockwise, negative where they turn the other way; signed, they add up to the ring."""
    row = np.repeat(np.arange(len(n)), np.maximum(n - 2, 0))
    side = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(n - 2, 0)) - np.maximum(n - 2, 0), np.maximum(n - 2, 0)) + 1
    tx, ty = (np.stack((v[row, 0], v[row, side], v[row, side + 1]), 1) for v in (x, y))
    sign = np.sign(areas(tx, ty, np.full(len(row), 3)))
    back = sign < 0
    tx[back], ty[back] = tx[back][:, ::-1], ty[back][:, ::-1]
    return row, tx, ty, sign


def _common_areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, s, w) with simple rings s, w to (a, b, area) of what they have in common.

    One ring is clipped by the other where that is convex; where neither is, by
    the signed triangles of the other.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        s, w = _corners(batch.column(2)), _corners(batch.column(3))
        by_w, by_s = _convex(*w), _convex(*s)
        area = np.zeros(batch.num_rows)
        pick = lambda ring, of: tuple(v[of] for v in ring)
        for own, subject, window in ((by_w, s, w), (by_s & ~by_w, w, s)):
            if own.any():
                area[own] = _clipped(*pick(subject, own), *pick(window, own))
        left = np.flatnonzero(~by_w & ~by_s)
        if len(left):
            row, tx, ty, sign = _fans(*pick(w, left))
            for low in range(0, len(row), TRIANGLES):
                part = slice(low, low + TRIANGLES)
                own = left[row[part]]
                np.add.at(area, own, sign[part] * _clipped(*pick(s, own), tx[part], ty[part], np.full(len(own), 3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.abs(area))], names=["a", "b", "area"])


def parcel_overlaps(parcels: DataFrame, cell: float, least: float) -> DataFrame:
    """(a, b, area): pairs a < b whose simple rings, of any shape and direction, overlap by more than ``least``.

    Boxes meet in cells; a pair counts only in the cell of its boxes' common
    lower-left corner, so it arises once and needs no DISTINCT.  Pairs whose
    boxes overlap by less are dropped there.  Where both rings are boxes, that
    is their area; the rest are clipped by whole Arrow batches, an edge of all
    windows at a time.  Each kind of ring is sent to its cells once.
    """
    boxes, others = boxes_apart(parcels.select("id", "ring"), cell)
    area = F.expr("(least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0))")

    def met(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
        p, q = left.alias("p"), right.alias("q").hint("merge")
        corner = (F.floor(F.greatest("p.x0", "q.x0") / cell) == F.col("p.cx")) & (F.floor(F.greatest("p.y0", "q.y0") / cell) == F.col("p.cy"))
        meet = F.expr(f"p.cx = q.cx and p.cy = q.cy and {order} and p.x0 < q.x1 and q.x0 < p.x1 and p.y0 < q.y1 and q.y0 < p.y1")
        return p.join(q, meet).where(corner & (area > least))

    point = lambda x, y: f"struct(q.{x} as x, q.{y} as y)"
    box = F.expr(f"array({', '.join(point(*c) for c in (('x0', 'y0'), ('x1', 'y0'), ('x1', 'y1'), ('x0', 'y1'), ('x0', 'y0')))})")
    of_boxes = met(boxes, boxes, "p.id < q.id").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), area.alias("area"))
    of_others = met(others, others, "p.id < q.id").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.ring").alias("s"), F.col("q.ring").alias("w"))
    mixed = met(others, boxes, "p.id != q.id").select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), F.col("p.ring").alias("s"), box.alias("w"))
    kind = dict(parcels.dtypes)["id"]
    clipped = of_others.unionAll(mixed).mapInArrow(_common_areas, f"a {kind}, b {kind}, area double")
    return of_boxes.unionAll(clipped.where(F.col("area") > least))


def points_in_parcels(points: DataFrame, parcels: DataFrame, cell: float) -> DataFrame:
    """(point, parcel) for each parcel ring that holds a point; boxes are tested before rings.

    Rings that are boxes are joined apart, by comparisons alone: the higher-order
    function that other rings need would keep the join from being compiled.
    """
    at = points.select(F.col("id").alias("point"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    boxes, others = boxes_apart(parcels.select(F.col("id").alias("parcel"), "ring"), cell)
    # As rings.contains() has it, the lower sides belong to a box.  The size of exploded cells is underestimated, so they are never broadcast.
    in_boxes = at.join(boxes.hint("merge"), ["cx", "cy"]).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return in_boxes.select("point", "parcel").unionAll(_in_rings(at, others))


def _in_rings(at: DataFrame, cells: DataFrame) -> DataFrame:
    near = at.join(cells.hint("merge"), ["cx", "cy"]).where("x between x0 and x1 and y between y0 and y1")
    return near.where(rings.contains(F.col("ring"), F.col("x"), F.col("y"))).select("point", "parcel")


def placed_in_parcels(at: DataFrame, parcels: DataFrame, cell: float) -> DataFrame:
    """points_in_parcels() of at(point, x, y, cx, cy), points whose cells are known; they are made once, so rings of all kinds are in one join."""
    return _in_rings(at, in_cells(boxed(parcels.select(F.col("id").alias("parcel"), "ring")), cell))


def near_pairs(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """(a_id, b_id, dist) of points within ``tol``: each a looks into its cell and the eight around."""
    return _in_cells(a, b, tol, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])


#: Sides of close_pairs()' cells, in tolerances: few points lie so near a border that they are copied.
WIDE = 8


def close_pairs(points: DataFrame, tol: float) -> DataFrame:
    """(a_id, b_id, dist) of points(id, x, y) within ``tol`` of each other, a_id < b_id.

    A point looks into its cell, and into those of the four after it that lie within ``tol`` of it.
    """
    cell, x, y = WIDE * tol, F.col("x"), F.col("y")
    cx, cy = F.floor(x / cell), F.floor(y / cell)
    # A hundredth more than the tolerance, as borders are rounded.
    right, top, bottom = (cx + 1) * cell - x <= 1.01 * tol, (cy + 1) * cell - y <= 1.01 * tol, y - cy * cell <= 1.01 * tol
    into = lambda i, j, near: F.when(near, F.struct((cx + i).alias("cx"), (cy + j).alias("cy"), F.lit(i == 0 and j == 0).alias("own")))
    cells = F.array_compact(F.array(into(0, 0, F.lit(True)), into(0, 1, top), into(1, -1, right & bottom), into(1, 0, right), into(1, 1, right & top)))
    left = points.select(F.col("id").alias("a_id"), x.alias("ax"), y.alias("ay"), F.explode(cells).alias("c")).select("a_id", "ax", "ay", "c.*")
    met = left.join(points.select(F.col("id").alias("b_id"), x.alias("bx"), y.alias("by"), cx.alias("cx"), cy.alias("cy")), ["cx", "cy"]).where("not own or a_id < b_id")
    found = met.withColumn("dist", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("dist") <= tol)
    return found.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "dist").where("a_id < b_id")


def _in_cells(a: DataFrame, b: DataFrame, tol: float, offsets: list[tuple[int, int]]) -> DataFrame:
    around: Column = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), around.alias("o"))
    left = left.withColumns({"cx": F.floor(F.col("ax") / tol) + F.col("o.i"), "cy": F.floor(F.col("ay") / tol) + F.col("o.j")})
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / tol).alias("cx"), F.floor(F.col("y") / tol).alias("cy"))
    return left.join(right, ["cx", "cy"]).withColumn("dist", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("dist") <= tol).select("a_id", "b_id", "dist")


def snap_query(points: DataFrame, nodes: DataFrame, tol: float) -> DataFrame:
    """(id, node, dist): the nearest node within ``tol`` of each point; ties by node."""
    best = near_pairs(points, nodes, tol).groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct(F.round("dist", 9).alias("dist"), "b_id")).alias("m"))
    return best.select("id", F.col("m.b_id").alias("node"), F.col("m.dist").alias("dist"))


def duplicate_nodes(nodes: DataFrame, tol: float) -> DataFrame:
    """(a_id, b_id, dist) of nodes a < b within ``tol``: the order is part of the join, so no pair is made twice."""
    return close_pairs(nodes, tol)

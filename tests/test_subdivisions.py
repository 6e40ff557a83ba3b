"""Lots on both sides of a street, their checks and envelopes, and control points, against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadastre.functions import rings
from cadastre.operators import design, places, spatial, topology

RING = "array<struct<x:double,y:double>>"
SPEC = design.LotSpec(50.0, 100.0, 6000.0, front=25.0, rear=10.0, side=5.0, max_ratio=3.0)


def boxes(spark, *rows):
    return spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")


def test_grid_along_either_axis(spark):
    parcels = boxes(spark, (1, 0.0, 0.0, 600.0, 300.0), (2, 10.0, 0.0, 310.0, 600.0), (3, 0.0, 0.0, 600.0, 200.0), (4, 0.0, 0.0, 260.0, 260.0), (5, 0.0, 0.0, None, 9.0))
    lots, streets = design.design_grid(parcels, SPEC, 60.0)
    totals = {r.id: (r.lots, r.lot_area, r.street_area) for r in design.design_totals(lots, parcels, streets).collect()}
    # 50 by 120 are 6,000; lots 100 deep need 60 of frontage, so 260 hold four; the third parcel is too shallow
    assert totals == {1: (24, 144000.0, 36000.0), 2: (24, 144000.0, 36000.0), 4: (8, 52000.0, 15600.0)}
    north = lots.where("id = 1 and block = 'B' and lot = 12").first()
    assert (north.x0, north.y0, north.x1, north.y1, north.front[0].y, north.front[1].x) == (550.0, 180.0, 600.0, 300.0, 180.0, 600.0)
    west = lots.where("id = 2 and block = 'A' and lot = 1").first()
    assert (west.x0, west.y0, west.x1, west.y1, west.front[0].x) == (10.0, 0.0, 130.0, 50.0, 130.0)
    assert streets.where("id = 2").first().centre == [(160.0, 0.0), (160.0, 600.0)]
    assert {r["count"] for r in design.design_grid(parcels.where("id = 1"), SPEC, 60.0, lots=4)[0].groupBy("block").count().collect()} == {4}
    assert design.design_grid(parcels.where("id = 1"), SPEC, 60.0, lots=13)[0].isEmpty() and design.design_grid(parcels.where("false"), SPEC, 60.0)[0].isEmpty()
    across, _ = design.design_grid(parcels.where("id = 1"), SPEC, 60.0, axis="y")
    assert across.first().depth == 270.0 and across.count() == 12


def test_strip_sides(spark):
    parcels = boxes(spark, (1, 0.0, 0.0, 100.0, 40.0))
    east = design.design_strip(parcels, 10.0, 50.0, 1000.0, "east").orderBy("lot").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in east] == [(0.0, 10.0 * i, 100.0, 10.0 * i + 10) for i in range(4)]
    assert design.design_strip(parcels, 10.0, 30.0, 100.0, "north", lots=3).count() == 3 and design.design_strip(parcels, 10.0, 30.0, 100.0, lots=11).isEmpty()
    with pytest.raises(ValueError):
        design.design_strip(parcels, 1.0, 1.0, 1.0, "up")


def test_issues(spark):
    lots = spark.createDataFrame([(1, "A", 1, 50.0, 120.0, 6000.0), (1, "A", 2, 10.0, 40.0, 400.0), (1, "A", 3, 0.0, 120.0, 0.0), (1, "A", 4, None, None, None), (1, "A", 5, 49.9999999, 100.0, 6000.0)], "id int, block string, lot int, frontage double, depth double, area double")
    got = {(r.lot, r.severity, r.issue): r.value for r in design.validate_design(lots, SPEC).collect()}
    assert got == {(2, "error", "area"): 400.0, (2, "error", "frontage"): 10.0, (2, "error", "depth"): 40.0, (2, "error", "envelope"): 0.0, (2, "warning", "ratio"): 4.0,
                   (3, "error", "area"): 0.0, (3, "error", "frontage"): 0.0, (3, "error", "envelope"): -10.0, (3, "warning", "ratio"): math.inf}
    assert design.validate_design(lots, SPEC._replace(max_ratio=None)).where("issue = 'ratio'").isEmpty()


def test_envelope_of_turned_and_skew_lots(spark):
    def turned(points, by):
        c, s = math.cos(by), math.sin(by)
        return [(c * x - s * y + 1000.0, s * x + c * y + 2000.0) for x, y in points]

    square = [(0.0, 0.0), (60.0, 0.0), (60.0, 100.0), (0.0, 100.0)]
    rows = [(i, turned(square, a) if i % 2 else turned(square, a)[::-1], turned(square[:2], a)) for i, a in enumerate((0.0, 0.3, 1.2, 2.9, 4.0))]
    # a five-sided lot: two rear edges meet in a point, so both sides of the peak are side edges but for the furthest middles
    rows.append((9, [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)], [(0.0, 50.0), (100.0, 50.0)]))
    rows.append((10, [(0.0, 0.0), (9.0, 0.0), (9.0, 50.0), (0.0, 50.0)], [(0.0, 0.0), (9.0, 0.0)]))
    lots = spark.createDataFrame(rows, f"id int, ring {RING}, front {RING}")
    got = {r.id: r.area for r in design.buildable_envelope(lots, SPEC).select("id", rings.signed_area(F.col("envelope")).alias("area")).collect()}
    assert all(abs(got[i] - 50 * 65) < 1e-6 for i in range(5)) and abs(got[9] - 90 * 15) < 1e-9 and got[10] is None
    far = design.buildable_envelope(lots.where("id = 9"), SPEC).first().envelope
    assert min(p.y for p in far) == 10.0 and max(p.y for p in far) == 25.0


def test_envelopes_of_many_lots_are_those_of_expressions(spark, monkeypatch):
    """Lots of all kinds are cut in batches, without expressions over their corners."""
    rng, rows = random.Random(5), []
    for i in range(300):
        a, width, depth = rng.uniform(0, 6), rng.uniform(5, 80), rng.uniform(10, 90)
        corners = [(0.0, 0.0), (width, 0.0), (width, 0.0), (width * rng.uniform(1, 1.3), depth), *([(width / 2, depth * 1.2)] if i % 3 else []), (0.0, depth)]
        corners = [(math.cos(a) * x - math.sin(a) * y + 500, math.sin(a) * x + math.cos(a) * y - 70) for x, y in corners]
        ring = [*corners, corners[0]]
        rows.append((i, ring[::-1] if i % 2 else ring, corners[:2] if i % 11 else None))
    rows += [(300, None, [(0.0, 0.0), (1.0, 0.0)]), (301, [], [(0.0, 0.0), (1.0, 0.0)]), (302, [(0.0, 0.0), (9.0, 0.0), (None, 9.0), (0.0, 0.0)], [(0.0, 0.0), (9.0, 0.0)]), (303, [(0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0)])]
    lots = spark.createDataFrame(rows, f"id int, ring {RING}, front {RING}")
    monkeypatch.setattr(design, "LOTS", 7)
    out = design.buildable_envelope(lots, SPEC)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.envelope for r in out.collect()}
    a, b = F.get("front", F.lit(0)), F.get("front", F.lit(1))
    away = lambda e: F.abs((b["x"] - a["x"]) * (e["a"]["y"] + e["b"]["y"] - 2 * a["y"]) - (b["y"] - a["y"]) * (e["a"]["x"] + e["b"]["x"] - 2 * a["x"]))
    most = F.array_max(F.transform(rings.edges(F.col("ring")), away))
    distance = lambda e: F.when(away(e) <= 1e-9 * F.col("most"), SPEC.front).when(away(e) >= (1 - 1e-9) * F.col("most"), SPEC.rear).otherwise(SPEC.side)
    want = {r.id: r.e if r.area is not None and r.area > 1e-9 else None for r in lots.withColumn("most", most).withColumn("e", rings.set_back(F.col("ring"), distance)).select("id", "e", rings.signed_area(F.col("e")).alias("area")).collect()}
    assert set(got) == set(want) and sum(e is not None for e in want.values()) > 100 and any(e is None for i, e in want.items() if i < 300)
    for i, e in want.items():
        assert (got[i] is None) == (e is None), i
        assert e is None or len(got[i]) == len(e) and all(abs(p.x - q.x) < 1e-9 and abs(p.y - q.y) < 1e-9 for p, q in zip(got[i], e, strict=True)), i


def test_design_as_fabric(spark):
    lots, streets = design.design_grid(boxes(spark, (1, 0.0, 0.0, 600.0, 300.0)), SPEC, 60.0, lots=2)
    parcels = design.design_parcels(lots, streets, "Elm")
    assert {r.id.name for r in parcels.collect()} == {"A-1", "A-2", "B-1", "B-2", "Elm.ROW"}
    nodes, sides, rejects = topology.build_fabric(parcels, 0.05)
    assert nodes.count() == 12 and sides.select("edge").distinct().count() == 18 and rejects.isEmpty()


def test_control_points(spark):
    ell = [(0.0, 0.0), (900.0, 0.0), (900.0, 300.0), (300.0, 300.0), (300.0, 900.0), (0.0, 900.0), (0.0, 0.0)]
    small = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    parcels = spark.createDataFrame([(1, ell), (2, small), (3, [])], f"id int, ring {RING}")
    rows = places.plan_control(parcels, 0.05).collect()
    one = sorted((r.k, r.role, r.x, r.y) for r in rows if r.id == 1)
    count = math.ceil(450000 / places.ACRE / 5)
    edge = round(count * 0.6)
    assert count == 23 and [k for k, *_ in one] == list(range(len(one))) and sum(role != "interior" for _, role, *_ in one) == edge
    grid = [(900 * i / 4, 900 * j / 4) for j in range(1, 4) for i in range(1, 4)]  # nine points asked for: three by three
    assert [(x, y) for _, role, x, y in one if role == "interior"] == [p for p in grid if p[0] < 300 or p[1] < 300]
    assert [r.role for r in rows if r.id == 2] == ["corner"] * 4 and not [r for r in rows if r.id == 3]
    wide = spark.createDataFrame([(1, [(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (0.0, 10.0), (0.0, 0.0)])], f"id int, ring {RING}")
    assert [(r.x, r.y) for r in places.aoi_interior_points(wide, 4).orderBy("k").collect()] == [(8.0, 5.0), (16.0, 5.0), (24.0, 5.0), (32.0, 5.0)]
    assert places.aoi_interior_points(wide, 0).isEmpty()


def test_close_pairs_are_all_pairs(spark):
    points = [(i, (i * 7919 % 997) / 100, (i * 104729 % 991) / 100) for i in range(300)] + [(300, 1.0, 1.0), (301, 1.0, 1.0)]
    got = {(r.a_id, r.b_id) for r in spatial.close_pairs(spark.createDataFrame(points, "id int, x double, y double"), 0.5).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.5}

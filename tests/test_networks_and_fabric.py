"""Goldens of network adjustment, welded fabrics, easements, surfaces and places."""

import math

import numpy as np
from pyspark.sql import functions as F

from cadastre.functions import geodesy, rings
from cadastre.operators import assessor, easements, fabric, network, places, spatial, surfaces, topology
from cadastre.operators.graphs import components
from cadastre.operators.graphs import places as list_places
from cadastre.sources import field


def square(x, y, w=1.0):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


RING = "id int, ring array<struct<x:double,y:double>>"


def test_triangle_of_three_four_five(spark):
    points = spark.createDataFrame([(1, "P1", 1, 0.0, 0.0, 0.0, True), (1, "P2", 2, 3.0, 0.0, 0.0, True), (1, "P3", 3, 2.9, 3.9, 0.0, False), (2, "A", 1, 0.0, 0.0, 0.0, False), (2, "B", 2, 1.0, 1.0, 0.0, False)], "net int, id string, ord int, x double, y double, z double, fixed boolean")
    obs = spark.createDataFrame([(1, i, "horizontal_distance", a, b, d, None, 0.005, False) for i, (a, b, d) in enumerate((("P1", "P2", 3.0), ("P2", "P3", 4.0), ("P1", "P3", 5.0)))] + [(2, 9, "azimuth", "A", "B", 0.5, None, None, False)], "net int, obs int, kind string, from_pt string, to_pt string, value double, vector array<double>, sigma double, rejected boolean")
    free = network.free_params(points)
    got, cofactors, rejects = network.adjust_networks(points, obs, free)
    p3 = got.where("id = 'P3'").first()
    assert abs(p3.x - 3) < 1e-3 and abs(p3.y - 4) < 1e-3 and p3.converged and p3.turns <= 4
    assert [tuple(r) for r in rejects.collect()] == [(2, "underdetermined")]
    rows, nets = network.residuals_blunders(got, obs.where("net = 1"), free, cofactors)
    assert nets.where("net = 1").first().redundancy == 0 and not network.chi_square_gate(nets).first().passes
    assert rows.count() == 2  # the distance between held points has no free coordinate
    assert {r.id for r in network.free_params(points, "minimal").where("net = 1").collect()} == {"P2", "P3"}
    assert network.free_params(points, "free").count() == 15


def test_ids_with_blanks_and_loose_networks(spark):
    points = spark.createDataFrame([("n 1", "P 1", 1, 0.0, 0.0, 0.0, True), ("n 1", "P 2", 2, 3.0, 0.0, 0.0, True), ("n 1", "P 3 x", 3, 2.9, 3.9, 0.0, False), ("n 2", "A", 1, 0.0, 0.0, 0.0, True), ("n 2", "B b", 2, 5.0, 1.0, 0.0, False), ("n 2", "C", 3, 0.0, 9.0, 0.0, True)], "net string, id string, ord int, x double, y double, z double, fixed boolean")
    rows = [("n 1", i, "horizontal_distance", a, b, d, None, 0.005, False) for i, (a, b, d) in enumerate((("P 1", "P 2", 3.0), ("P 2", "P 3 x", 4.0), ("P 1", "P 3 x", 5.0)))]
    rows += [("n 2", i, "horizontal_distance", "A", "B b", 5.0, None, 0.005, False) for i in range(3)]
    obs = spark.createDataFrame(rows, "net string, obs int, kind string, from_pt string, to_pt string, value double, vector array<double>, sigma double, rejected boolean")
    got, cofactors, rejects = network.adjust_networks(points, obs, network.free_params(points))
    p = got.where("net = 'n 1' and id = 'P 3 x'").first()
    assert abs(p.x - 3) < 1e-3 and abs(p.y - 4) < 1e-3 and p.converged and p.turns <= 4 and p.free == 0
    loose = got.where("net = 'n 2' and id = 'B b'").first()
    assert loose.free == 1 and abs(math.hypot(loose.x, loose.y) - 5) < 1e-3 and rejects.count() == 0
    assert {(r.i.id, r.i.axis) for r in network.point_sigmas(cofactors).where("net = 'n 1'").collect()} == {("P 3 x", "x"), ("P 3 x", "y")}


def test_all_kinds_of_observation_are_adjusted(spark):
    """A point seen by every kind from held stations comes to where they were made from."""
    stations = {"A": (0.0, 0.0, 0.0), "B": (100.0, 0.0, 2.0), "C": (0.0, 80.0, -3.0), "D": (90.0, 95.0, 5.0), "E": (-40.0, 30.0, 1.0)}
    x, y, z = 37.0, 41.0, 4.0
    rows = []
    for i, (kind, (k, (a, b, c))) in enumerate(zip(("azimuth", "horizontal_distance", "slope_distance", "height_difference", "gnss"), stations.items(), strict=True)):
        d = (x - a, y - b, z - c)
        value = {"azimuth": math.atan2(d[0], d[1]), "horizontal_distance": math.hypot(*d[:2]), "slope_distance": math.hypot(*d), "height_difference": d[2], "gnss": None}[kind]
        rows.append((1, i, kind, k, "P", value, list(d) if kind == "gnss" else None, None, False))
    obs = spark.createDataFrame(rows, "net int, obs int, kind string, from_pt string, to_pt string, value double, vector array<double>, sigma double, rejected boolean")
    points = spark.createDataFrame([(1, k, i, *p, True) for i, (k, p) in enumerate(stations.items())] + [(1, "P", 9, 33.0, 45.0, 0.0, False)], "net int, id string, ord int, x double, y double, z double, fixed boolean")
    got, cofactors, _ = network.adjust_networks(points, obs, network.free_params(points))
    p = got.where("id = 'P'").first()
    assert max(abs(p.x - x), abs(p.y - y), abs(p.z - z)) < 1e-6 and p.converged and p.free == 0
    _, nets = network.residuals_blunders(got, obs, network.free_params(points), cofactors)
    assert nets.first().redundancy == 4 and nets.first().sigma0_sq < 1e-6


def test_networks_are_brought_together_once_whatever_their_size(spark):
    """Cofactors, corrections and residuals of random networks against dense matrices of jacobian_rows(), with networks that go on over Arrow batches."""
    rng = np.random.default_rng(3)
    kinds = ("azimuth", "horizontal_distance", "slope_distance", "height_difference", "gnss", "horizontal_angle", "note")
    points, obs = [], []
    for net, n in ((1, 3), (2, 9), (3, 3), (4, 1), (5, 4), (None, 2)):
        points += [(net, f"p {i}", i, *rng.uniform(0, 100, 3).tolist(), i < 2) for i in range(n)]
        for k in range(12 * n):
            a, b = rng.integers(0, n + 1, 2).tolist()  # point n isn't there, and ends may coincide
            value = None if k % 17 == 5 else float(rng.uniform(0, 50))
            obs.append((net, k, kinds[k % 7], f"p {a}", f"p {b}", value, rng.uniform(-50, 50, 3).tolist(), (None, 0.01, 0.02)[k % 3], k % 11 == 3))
    points.append((5, "p null", 9, None, 1.0, 2.0, False))
    obs += [(5, 100 + i, kind, "p 0", "p null", 3.0, [1.0, 2.0, 3.0], 0.01, False) for i, kind in enumerate(kinds)] + [(9, 1, "azimuth", "p 0", "p 1", 1.0, None, None, False)]
    points = spark.createDataFrame(points, "net int, id string, ord int, x double, y double, z double, fixed boolean")
    obs = spark.createDataFrame(obs, "net int, obs int, kind string, from_pt string, to_pt string, value double, vector array<double>, sigma double, rejected boolean").repartition(3)
    free = network.free_params(points)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, cofactors, rejects = network.adjust_networks(points, obs, free, most=1)
        residuals, nets = network.residuals_blunders(points, obs, free, cofactors)
        assert residuals._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(net") <= 4  # the tables, and cofactors; no join of rows with rows
        got, found = {(r.net, r.id): r for r in got.collect()}, {(r.net, r.obs, r.part): r for r in residuals.collect()}
        nets, q = {r.net: r for r in nets.collect()}, {(r.net, r.i.id + r.i.axis, r.j.id + r.j.axis): r.value for r in cofactors.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    first = {(r.net, r.id): r for r in points.collect()}
    rows = {}
    for r in network.jacobian_rows(points, obs, free).collect():
        rows.setdefault(r.net, []).append(r)
    assert {r.net for r in rejects.collect()} == {4, None} and set(rows) == {1, 2, 3, 5} == set(nets)
    seen = 0
    for net, own in rows.items():
        keys, params = sorted({tuple(r.row) for r in own}), sorted({r.id + r.axis for r in own})
        a, off, w = np.zeros((len(keys), len(params))), np.zeros(len(keys)), np.zeros(len(keys))
        for r in own:
            k = keys.index(tuple(r.row))
            a[k, params.index(r.id + r.axis)] += r.coef
            off[k], w[k] = r.misclosure, r.weight
        inverse = np.linalg.pinv(a.T @ (w[:, None] * a))
        dx = inverse @ (a.T @ (w * off))
        assert np.allclose([[q[net, i, j] for j in params] for i in params], inverse, rtol=1e-6, atol=1e-12)
        for i, d in zip(params, dx, strict=True):
            assert math.isclose(got[net, i[:-1]][i[-1]] - first[net, i[:-1]][i[-1]], d, rel_tol=1e-6, abs_tol=1e-9)
        for k, key in enumerate(keys):
            room = max(1 / w[k] - a[k] @ inverse @ a[k], 1e-30)
            r = found[net, *key]
            seen += 1
            assert math.isclose(r.v, -off[k], abs_tol=1e-9) and (room < 1e-9 or math.isclose(r.standardized, -off[k] / math.sqrt(room), rel_tol=1e-5))
        assert nets[net].redundancy == len(keys) - len(params) and math.isclose(nets[net].sigma0_sq, (w * off * off).sum() / (len(keys) - len(params)), rel_tol=1e-9)
    assert seen == len(found) and got[5, "p null"].x is None and set(got) == {k for k in first if k[0] in rows}


def test_chi_square_quantiles():
    for p, r, value in ((0.025, 1, 0.000982069), (0.975, 10, 20.48318), (0.975, 1, 5.02389), (0.025, 30, 16.79077)):
        assert math.isclose(network.chi_square_quantile(p, r), value, rel_tol=1e-5)


def test_components_of_chains(spark):
    links = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))
    assert {r.component for r in components(links).collect()} == {0, 100}


def test_components_in_few_turns_whatever_the_order(spark):
    n = 1000
    order = [0, *range(n, 0, -1)]
    rows = list(zip(order, order[1:], strict=False))
    star = [(5000 + i, 9999) for i in range(300)]
    comb = [(20_000 + i, 20_000 + (i * 7919 + 1) % 997) for i in range(997)]
    turns = []
    got = {r.id: r.component for r in components(spark.createDataFrame([*rows, *star, *comb, (7, 7), (60_000, 60_000)], "a long, b long"), turns).collect()}
    assert {got[i] for i in range(n + 1)} == {0} and {got[a] for a, _ in star} == {5000} == {got[9999]} and got[60_000] == 60_000
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in comb:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(got[a] == find(a) for a, _ in comb) and len(turns) <= 25
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_places_of_wide_ids_are_found_by_numbers(spark, monkeypatch):
    from cadastre.operators import graphs

    kept, write = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, label: (kept.append((label, dict(df.dtypes))), write(df, label))[1])
    rows = [((1, f"a{i}"), (1, f"a{i - 1}") if i else None) for i in range(9)] + [((2, "x"), (2, "nowhere")), ((3, "r"), (3, "s")), ((3, "s"), (3, "r"))]
    steps = spark.createDataFrame(rows, "id struct<d:int,v:string>, prev struct<d:int,v:string>")
    assert {(tuple(r.id), tuple(r.head), r.place) for r in list_places(steps).collect()} == {((1, f"a{i}"), (1, "a0"), i) for i in range(9)}
    assert {(tuple(r.id), r.place) for r in list_places(steps, heads=False).collect()} == {((1, f"a{i}"), i) for i in range(9)}
    assert all(set(t.values()) == {"bigint"} for label, t in kept if label == "places")


def test_places_on_lists(spark):
    n = 300
    ids = [(i * 7919) % 10_007 for i in range(n)]
    steps = [(b, a) for a, b in zip([None, *ids], ids, strict=False)] + [(20_000, None), (30_000, 30_001), (30_001, 30_000)]
    got = {r.id: (r.head, r.place) for r in list_places(spark.createDataFrame(steps, "id long, prev long")).collect()}
    assert got == {x: (ids[0], i) for i, x in enumerate(ids)} | {20_000: (20_000, 0)}


def test_weld_merge_and_reject(spark):
    parcels = spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(1.004, 0.0)), (3, square(9.0, 9.0)), (4, square(20.0, 20.0, 0.001))], RING)
    nodes, sides, rejects = topology.build_fabric(parcels, 0.01)
    assert [tuple(r) for r in rejects.collect()] == [(4, "fewer than three corners")] and nodes.count() == 10
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (1, 9), (3, 9)], "id int, grp int")
    merged, bad = topology.merge_parcels(nodes, sides, groups)
    sizes = {r.grp: len(r.ring) - 1 for r in merged.collect()}
    assert sizes == {7: 6, 8: 4} and [r.grp for r in bad.collect()] == [9]


def test_split_and_issues(spark):
    parcels = spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(1.0, 0.0)), (3, [(5.0, 5.0), (6.0, 6.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)])], RING)
    cuts = spark.createDataFrame([(1, (-1.0, 0.4), (2.0, 0.4)), (3, (9.0, 9.0), (10.0, 10.0))], "id int, a struct<x:double,y:double>, b struct<x:double,y:double>")
    parts, bad = topology.split_parcels(parcels, cuts)
    got = {(r.id, r.part): len(r.ring) - 1 for r in parts.collect()}
    assert got == {(1, 1): 4, (1, 2): 4, (2, 0): 5} and [tuple(r) for r in bad.collect()] == [(3, 0)]
    assert [r.id for r in topology.self_intersections(parcels).collect()] == [3]


def test_rubber_sheet_of_many_controls(spark):
    controls = spark.range(1500).select(F.col("id").alias("ord"), (F.col("id") * 1.0).alias("sx"), F.lit(0.0).alias("sy"), (F.col("id") + 1.0).alias("tx"), F.lit(2.0).alias("ty"))
    nodes = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.5, 7.0)], "id int, x double, y double")
    got = {r.id: (round(r.x, 6), round(r.y, 6)) for r in fabric.rubber_sheet(nodes, controls).collect()}
    assert got == {1: (11.0, 2.0), 2: (11.5, 9.0)}


def test_easement_corner_and_conflict(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0)], 10.0), (2, [(50.0, -50.0), (50.0, 50.0)], 8.0), (3, [(0.0, 900.0), (9.0, 900.0)], 2.0), (4, [(1.0, 1.0)], 2.0)], "id int, centerline array<struct<x:double,y:double>>, width_m double")
    left = {(r.id, r.seq): (r.x + r.ox, r.y + r.oy) for r in easements.offsets(lines).collect()}
    assert np.allclose(left[1, 1], (95.0, 5.0)) and np.allclose(left[1, 2], (95.0, 100.0))
    assert [(r.a, r.b, round(r.area, 6), r.severity) for r in easements.easement_conflicts(lines, 64.0).collect()] == [(1, 2, 80.0, "overlap")]
    assert {r.id: round(r.area, 6) for r in easements.strip_areas(lines).collect()} == {1: 2000.0, 2: 800.0, 3: 18.0}


def test_overlaps_of_any_simple_rings(spark):
    """Concave, star-shaped and clockwise rings against a fine grid."""
    rng = np.random.default_rng(4)
    ell = [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0), (0.0, 0.0)]
    shapes = [(0, ell), (1, square(-1.0, -1.0, 4.0)), (2, [(x + 1.0, y + 1.0) for x, y in ell][::-1]), (3, square(3.0, 3.0, 2.0))]
    for i in range(4, 12):
        angles, radii = np.sort(rng.random(9)) * 2 * math.pi, 1 + 3 * rng.random(9)
        ring = [(3 + float(r * math.cos(a)), 3 + float(r * math.sin(a))) for a, r in zip(angles, radii, strict=True)]
        ring.append(ring[0])
        shapes.append((i, ring[::-1] if i % 2 else ring))
    step = 0.01
    gx, gy = np.meshgrid(np.arange(-2, 9, step) + step / 2, np.arange(-2, 9, step) + step / 2)

    def inside(ring):
        out = np.zeros(gx.shape, dtype=bool)
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            if y0 != y1:
                out ^= ((y0 > gy) != (y1 > gy)) & (gx < (x1 - x0) * (gy - y0) / (y1 - y0) + x0)
        return out

    masks = {i: inside(r) for i, r in shapes}
    got = {(r.a, r.b): r.area for r in spatial.parcel_overlaps(spark.createDataFrame(shapes, RING), 4.0, 1e-9).collect()}
    for a in masks:
        for b in masks:
            if a < b:
                assert abs(got.get((a, b), 0.0) - (masks[a] & masks[b]).sum() * step * step) < 0.15, (a, b)
    assert (0, 3) not in got and math.isclose(got[0, 1], 8.0)


def test_bounds_of_rings_are_those_of_expressions_and_made_once(spark):
    """In batches: what a ring is made from isn't repeated for its bounds and whether it is a box."""
    nan, inf = float("nan"), float("inf")
    box = [(1.0, 2.0), (5.0, 2.0), (5.0, 4.0), (1.0, 4.0), (1.0, 2.0)]
    up = [(1.0, 2.0), (1.0, 4.0), (5.0, 4.0), (5.0, 2.0), (1.0, 2.0)]
    odd = [box, up, box[::-1], up[::-1], box[:4], box[:-1] + [(1.0, 2.5)], [*box, (1.0, 2.0)], [(0.0, 0.0), (4.0, 1.0), (3.0, 5.0), (0.0, 0.0)], [(0.0, 0.0), (2.0, 2.0), (0.0, 0.0), (2.0, 2.0), (0.0, 0.0)], [(3.0, 3.0)] * 5, [(nan, 2.0), (5.0, 2.0), (5.0, 4.0), (nan, 4.0), (nan, 2.0)], [(inf, 2.0), (5.0, 2.0), (5.0, 4.0), (inf, 4.0), (inf, 2.0)], [(None, 2.0), (5.0, 2.0), (5.0, 4.0), (None, 4.0), (None, 2.0)], [(1.0, 2.0), None, (5.0, 4.0), (1.0, 4.0), (1.0, 2.0)], [(nan, None), (None, None)], [], None]
    parcels = spark.createDataFrame([(i, ring) for i, ring in enumerate(odd)], RING).repartition(3)
    key = lambda r: (r.id, *map(str, (r.x0, r.y0, r.x1, r.y1)))
    want = {r.id: (key(r), r.box) for r in spatial.with_box(parcels).withColumn("box", rings.is_box(F.col("ring"))).collect()}
    assert {key(r) for r in spatial.boxed(parcels).collect()} == {k for k, _ in want.values()}
    for box_ in (True, False):
        own = spatial.boxed(parcels, box_)
        assert {key(r) for r in own.collect()} == {k for k, b in want.values() if b == box_} and ("ring" in own.columns) != box_
    plan = spatial.parcel_overlaps(parcels, 64.0, 1e-6)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan and "lambda" not in plan


def test_points_in_boxes_and_other_rings(spark):
    """Boxes of either direction and start, and rings that only look like boxes, hold the points that ray casting says; boxes' joins are compiled and not broadcast."""
    turned = square(2.0, 1.0, 3.0)
    shapes = [(0, square(0.0, 0.0, 4.0)), (1, turned[::-1]), (2, turned[1:] + turned[1:2]), (3, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (1.0, 4.0), (0.0, 0.0)]), (4, [(1.0, 1.0), (1.0, 5.0), (3.0, 5.0), (3.0, 1.0), (1.0, 1.0)])]
    shapes += [(5, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]), (6, [(0.0, 0.0), (2.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0), (0.0, 0.0)]), (7, [(1.0, 2.0), (1.0, 2.0), (1.0, 3.0), (1.0, 3.0), (1.0, 2.0)])]
    points = spark.createDataFrame([(i * 13 + j, i / 2, j / 2) for i in range(13) for j in range(13)] + [(999, None, 1.0)], "id int, x double, y double")
    parcels = spark.createDataFrame(shapes, RING)
    assert {r.id for r in parcels.where(rings.is_box(F.col("ring"))).collect()} == {0, 1, 2, 4, 7}
    want = {(r.point, r.parcel) for r in points.withColumnRenamed("id", "point").crossJoin(parcels.withColumnRenamed("id", "parcel")).where(rings.contains(F.col("ring"), F.col("x"), F.col("y"))).collect()}
    found = spatial.points_in_parcels(points, parcels, 2.0)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) > 0 and set(got) == want
    of_boxes = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "filter(" not in of_boxes
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_overlaps_of_boxes_and_other_rings(spark):
    """Boxes among themselves, with other rings of smaller and larger ids, and touching ones; of boxes alone nothing gets to Python."""
    triangle = [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
    shapes = [("a", square(0.0, 0.0, 4.0)), ("b", triangle), ("c", square(2.0, 1.0, 5.0)[::-1]), ("d", square(4.0, 0.0, 1.5)), ("e", [(x - 1.0, y + 1.0) for x, y in triangle][::-1]), ("f", square(0.0, 0.0, 4.0))]
    found = spatial.parcel_overlaps(spark.createDataFrame(shapes, "id string, ring array<struct<x:double,y:double>>"), 2.0, 1e-9)
    got = sorted((r.a, r.b, round(r.area, 9)) for r in found.collect())
    want = {"ab": 16.0, "ac": 6.0, "ae": 12.0, "af": 16.0, "bc": 12.5, "bd": 2.25, "be": 24.5, "bf": 16.0, "cd": 0.75, "ce": 12.5, "cf": 6.0, "de": 0.75, "ef": 12.0}
    assert [(a, b) for a, b, _ in got] == sorted(map(tuple, want)), got
    assert all(math.isclose(area, want[a + b]) for a, b, area in got), got
    only = spatial.parcel_overlaps(spark.createDataFrame([(i, square(i * 0.5, 0.0)) for i in range(9)], RING), 2.0, 1e-9)
    assert {(r.a, r.b): r.area for r in only.collect()} == {(i, i + 1): 0.5 for i in range(8)}
    assert "EmptyRelation" in only._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_delaunay_circles_are_empty():
    rng = np.random.default_rng(1)
    points = rng.random((60, 2)) * 50
    tri = surfaces._delaunay(points)
    for t in tri:
        a, b, c = points[t]
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        x = ((a @ a) * (b[1] - c[1]) + (b @ b) * (c[1] - a[1]) + (c @ c) * (a[1] - b[1])) / d
        y = ((a @ a) * (c[0] - b[0]) + (b @ b) * (a[0] - c[0]) + (c @ c) * (b[0] - a[0])) / d
        r = np.hypot(a[0] - x, a[1] - y)
        others = np.delete(points, t, axis=0)
        assert (np.hypot(others[:, 0] - x, others[:, 1] - y) > r - 1e-9).all()
    assert len(surfaces._delaunay(np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]]))) == 2


def test_plane_contour_and_height(spark):
    points = spark.createDataFrame([("c", float(x), float(y), float(x)) for x in range(5) for y in range(5)], "cloud string, x double, y double, z double")
    triangles = surfaces.tin_tiles(points, 100.0, 10.0)
    assert triangles.count() == 32
    segments = surfaces.contour_segments(triangles, 2.5).where("elev = 2.5")
    chains = surfaces.contour_chains(segments).collect()
    assert len(chains) == 1 and all(abs(p.x - 2.5) < 1e-6 for p in chains[0].line) and {chains[0].line[0].y, chains[0].line[-1].y} == {0.0, 4.0}
    at = spark.createDataFrame([("c", 1, 1.25, 3.0), ("c", 2, 9.0, 9.0)], "cloud string, id int, x double, y double")
    assert {r.id: r.z for r in surfaces.tin_interpolate(triangles, at, 2.0).collect()} == {1: 1.25, 2: None}


def test_ground_under_a_house(spark):
    rows = [("c", i, float(i % 20), float(i // 20), 10.0 if 6 <= i % 20 <= 10 and 6 <= i // 20 <= 10 else 0.0) for i in range(400)]
    points = spark.createDataFrame(rows, "cloud string, id int, x double, y double, z double")
    for judged in (surfaces.classify_ground_smrf(points), surfaces.classify_ground_pmf(points)):
        assert {r.z for r in judged.where("ground").collect()} == {0.0} and judged.where("not ground").count() == 25


def test_utm_and_design(spark):
    row = spark.range(1).select(*geodesy.utm(F.lit(-97.7431), F.lit(30.2672))).first()
    assert row[0] == 14 and abs(row[1] - 620_897) < 60 and abs(row[2] - 3_349_151) < 120
    tower = spark.range(1).select(*geodesy.utm(F.lit(-79.387139), F.lit(43.642567))).first()
    south = spark.range(1).select(*geodesy.utm(F.lit(-79.387139), F.lit(-43.642567))).first()
    assert tower[0] == 17 and abs(tower[1] - 630_084) < 1 and abs(tower[2] - 4_833_438) < 1 and abs(south[1] - tower[1]) < 1e-6 and abs(south[2] + tower[2] - 10_000_000) < 1e-6
    tiles = spark.createDataFrame([(1, square(0.0, 0.0, 10.0)), (2, square(500.0, 0.0, 10.0))], RING)
    moved = spark.createDataFrame([(7, square(0.5, 0.0, 10.0)), (8, square(300.0, 0.0, 10.0))], RING)
    got = {r.id: (r.parcel, round(r.max_deviation, 6)) for r in assessor.reconcile_design(moved, tiles, 5.0, 1.0).collect()}
    assert got == {7: (1, 0.5), 8: (2, 200.0)} and assessor.reconcile_design(moved, tiles.where("false"), 5.0).count() == 0


def test_gsi_square(spark):
    text = "\n".join(f"11....+0000000{i} 84..00+00000000\n11....+0000000{i + 1} 21.324+000000{90 * i:03d}0000000 32..06+00010000" for i in range(4))
    found = field.scan_gsi(field.lines_of(spark.createDataFrame([("f", text)], "file string, text string")))
    assert found.setups.count() == 4 and found.observations.where("kind = 'SD'").agg(F.sum("value")).first()[0] == 40.0
    assert sorted(round(math.degrees(r.value)) for r in found.observations.where("kind = 'HA'").collect()) == [0, 90, 180, 270]


def test_splitting_broadcasts_no_parcels(spark, tmp_path):
    spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(1.0, 0.0))], RING).write.parquet(f"{tmp_path}/parcels")
    parcels = spark.read.parquet(f"{tmp_path}/parcels")
    cuts = spark.createDataFrame([(1, (-1.0, 0.4), (2.0, 0.4))], "id int, a struct<x:double,y:double>, b struct<x:double,y:double>")
    parts, _ = topology.split_parcels(parcels, cuts)
    assert "Broadcast" not in parts._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.part) for r in parts.collect()} == {(1, 1), (1, 2), (2, 0)}


def test_gate_of_many_observations_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    from cadastre.plans.registry import ORACLES, QUERIES
    import __spark_entry__  # noqa: F401  registers the queries

    kinds = (15140, 16820, 18242, 2911, 1539, 6810, 685, 17269, 16554, 3773, 17366, 1287, 6621, 19550)
    rows = [(911, k + 1, part, 1, 10.0, 1.0) for k, part in enumerate(kinds)] + [(7, k + 1, part, 1, 10.0, 1.0) for k, part in enumerate(kinds[:4])]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["chi_square_gate"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert set(db.execute(ORACLES["chi_square_gate"]).fetchall()) == got and (911, 12, True) in got


def test_fits_are_found_where_networks_are_adjusted(spark):
    """The same as residuals at adjusted points, rejected and loose networks too, from one bringing together; the gate reads them once."""
    rng = np.random.default_rng(8)
    points, obs = [], []
    for net in (*range(1, 12), None):
        n = 1 + (net or 2) % 5
        points += [(net, f"p {i}", i, *rng.uniform(0, 100, 3).tolist(), i < 2) for i in range(n)]
        for k in range(5 * n):
            a, b = rng.integers(0, n + 1, 2).tolist()
            kind = ("horizontal_distance", "gnss", "slope_distance", "azimuth", "height_difference")[k % 5]
            obs.append((net, k, kind, f"p {a}", f"p {b}", float(rng.uniform(1, 50)), rng.uniform(-50, 50, 3).tolist(), 9.0, k % 11 == 3))
    points = spark.createDataFrame(points, "net int, id string, ord int, x double, y double, z double, fixed boolean")
    obs = spark.createDataFrame(obs, "net int, obs int, kind string, from_pt string, to_pt string, value double, vector array<double>, sigma double, rejected boolean")
    free = network.free_params(points)
    at, cofactors, rejects = network.adjust_networks(points, obs, free)
    want = {r.net: (r.redundancy, r.sigma0_sq) for r in network.residuals_blunders(at, obs, free, cofactors)[1].collect()}
    gated = network.chi_square_gate(network.network_fits(points, obs, free))
    plan = gated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Broadcast" not in plan and not rejects.isEmpty()
    got = {r.net: (r.redundancy, r.sigma0_sq, r.passes) for r in gated.collect()}
    assert set(got) == set(want) and all(got[n][0] == r and math.isclose(got[n][1], v, rel_tol=1e-9, abs_tol=1e-12) for n, (r, v) in want.items())
    between = lambda r, v: r > 0 and network.chi_square_quantile(0.025, r) <= r * v <= network.chi_square_quantile(0.975, r)
    assert {n: g[2] for n, g in got.items()} == {n: between(*w) for n, w in want.items()} and len({g[2] for g in got.values()}) == 2


def test_welding_by_cells_agrees_with_brute_force(spark):
    tol = 0.01
    spots = [(round(((i * 37) % 101) * 0.0041 - 0.2, 6), round(((i * 61) % 89) * 0.0043 - 0.2, 6)) for i in range(700)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id int, x double, y double")
    got = {(r.a_id, r.b_id) for r in spatial.close_pairs(points, tol).collect()}
    assert got == {(i, j) for i in range(700) for j in range(i + 1, 700) if math.hypot(spots[i][0] - spots[j][0], spots[i][1] - spots[j][1]) <= tol}
    alone = [(i, [(x, y), (x + 5.0, y), (x + 5.0, y + 5.0 + i / 7), (x, y)]) for i, (x, y) in enumerate((k * 0.64 - 3.2 + e, k * 0.64 + e) for k in range(0, 40, 3) for e in (-0.004, 0.004))]
    corners = [((i, s), p) for i, ring in alone for s, p in enumerate(ring[:-1])]
    root = {c: c for c, _ in corners}
    for _ in range(6):
        for c, p in corners:
            root[c] = min(root[d] for d, q in corners if math.hypot(p[0] - q[0], p[1] - q[1]) <= tol)
    assert {((r.id, r.seq), tuple(r.node)) for r in topology.snap_nodes(spark.createDataFrame(alone, RING), tol).collect()} == set(root.items())


def test_few_places_are_paired_in_a_fabric(spark, monkeypatch):
    paired = []
    close_pairs = spatial.close_pairs
    monkeypatch.setattr(spatial, "close_pairs", lambda points, tol: paired.append(points.count()) or close_pairs(points, tol))
    parcels = spark.createDataFrame([(i, square(20.0 * i + 5.0, 5.0, 20.0)) for i in range(30)], RING)
    nodes, sides, rejects = topology.build_fabric(parcels, 1e-4)
    assert nodes.count() == 62 and sides.count() == 120 and rejects.isEmpty() and paired[0] < 62


def test_fabric_reads_parcels_once(spark, tmp_path):
    """Sides come from the written corners alone, without lists of corners; rings that lack corners still count."""
    rows = [(1, square(0.0, 0.0)), (2, square(1.0, 0.0)), (3, [(5.0, 5.0), (6.0, 5.0), (None, 6.0), (5.0, 6.0), (5.0, 5.0)]), (4, [(8.0, 8.0)]), (5, None), (6, [(9.0, 9.0), (9.0, 9.0), (9.5, 9.0), (9.0, 9.0)])]
    spark.createDataFrame(rows, RING).write.parquet(f"{tmp_path}/parcels")
    parcels = spark.read.parquet(f"{tmp_path}/parcels")
    nodes, sides, rejects = topology.build_fabric(parcels, 0.01)
    assert sorted((r.id, r.seq, r.p.id, r.p.seq, r.q.id, r.q.seq) for r in sides.collect()) == [(1, 0, 1, 0, 1, 1), (1, 1, 1, 1, 1, 2), (1, 2, 1, 2, 1, 3), (1, 3, 1, 3, 1, 0), (2, 0, 1, 1, 2, 1), (2, 1, 2, 1, 2, 2), (2, 2, 2, 2, 1, 2), (2, 3, 1, 2, 1, 1), (3, 0, 3, 0, 3, 1), (3, 1, 3, 1, 3, 3), (3, 3, 3, 3, 3, 0)]
    assert nodes.count() == 9 and {(r.id, r.reason) for r in rejects.collect()} == {(i, "fewer than three corners") for i in (4, 5, 6)}
    _, sides, _ = topology.build_fabric(parcels.where("id < 3"), 0.01)
    plan = sides._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "ring" not in plan
    twice = parcels.where("id < 3").union(parcels.where("id = 3").selectExpr("1 as id", "ring")).union(parcels.where("id = 5").selectExpr("2 as id", "ring"))
    nodes, sides, rejects = topology.build_fabric(twice, 0.01)
    assert sides.isEmpty() and nodes.isEmpty() and {(r.id, r.reason) for r in rejects.collect()} == {(i, "id used twice") for i in (1, 2)}


def test_fabric_rejects_an_id_of_an_empty_and_a_whole_ring(spark):
    parcels = spark.createDataFrame([(1, square(0.0, 0.0)), (1, []), (2, square(1.0, 0.0)), (3, []), (4, None), (5, square(9.0, 9.0)), (5, square(9.0, 9.0))], RING)
    _, sides, rejects = topology.build_fabric(parcels, 0.01)
    assert {r.id for r in sides.select("id").distinct().collect()} == {2}
    assert {tuple(r) for r in rejects.collect()} == {(1, "id used twice"), (5, "id used twice"), (3, "fewer than three corners"), (4, "fewer than three corners")}

"""Replayed and live polygon editing, presence, and lines on the ellipsoid."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.functions import geodesics
from cadastre.operators import editlog, geodetic
from cadastre.streaming import live

OPS = "doc int, kind string, vertex string, after string, x double, y double, ts long, actor string"


def rings(df):
    out = {}
    for r in df.orderBy("doc", "pos").collect():
        out.setdefault(r.doc, []).append((r.vertex, r.x, r.y))
    return out


def replayed(ops):
    """Plain rule: earliest inserts make a forest that is walked depth first, siblings by (ts, actor, vertex)."""
    out = {}
    for doc in {o[0] for o in ops}:
        own = [o for o in ops if o[0] == doc]
        made = {}
        for _, kind, v, after, x, y, ts, actor in own:
            if kind == "insert" and x is not None and y is not None:
                made[v] = min(made.get(v, ((math.inf, ""),)), ((ts, actor), x, y, after or ""))
        kids = {}
        for v, (stamp, _, _, after) in made.items():
            kids.setdefault(after if after in made and made[after][0] < stamp else None, []).append((stamp, v))
        gone, ring = {o[2] for o in own if o[1] == "delete"}, []
        stack = sorted(kids.get(None, []), reverse=True)
        while stack:
            stamp, v = stack.pop()
            stack += sorted(kids.get(v, []), reverse=True)
            moves = [((o[6], o[7]), o[4], o[5]) for o in own if o[1] == "move" and o[2] == v and o[4] is not None and (o[6], o[7]) > stamp]
            if v not in gone:
                ring.append((v, *max([(stamp, *made[v][1:3]), *moves])[1:]))
        if ring:
            out[doc] = ring
    return out


def edits(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(1, "insert", "v1", None, 0.0, 0.0, 1, "A"), (1, "insert", "v2", "v1", 1.0, 0.0, 2, "A"), (1, "insert", "v3", "v2", 2.0, 0.0, 3, "A"), (1, "insert", "v4", "v2", 1.5, 0.5, 3, "B"), (1, "move", "v1", None, 9.0, 9.0, 5, "A"), (1, "move", "v1", None, 8.0, 8.0, 5, "B")]
    rows += [(1, "delete", "v3", None, None, None, 4, "B"), (1, "move", "v3", None, 7.0, 7.0, 10**15, "B"), (1, "insert", "v3", "v1", 7.0, 7.0, 10**15, "B"), (1, "move", "nobody", None, 1.0, 1.0, 1, "A"), (1, "insert", "w", "v1", None, 1.0, 2, "A"), (1, None, "v1", None, 1.0, 1.0, 99, "A")]
    for ts in range(n):
        kind = rng.choice(["insert"] * 6 + ["move"] * 3 + ["delete"] * (ts % 4 == 0))
        rows.append((rng.choice([2, 3]), kind, f"p{rng.randrange(n // 2)}", rng.choice([None, *(f"p{rng.randrange(n // 2)}" for _ in range(6))]), rng.random(), rng.random(), rng.randrange(n), rng.choice("ABC")))
    return rows + [(4, "insert", f"c{i:03}", f"c{i - 1:03}" if i else None, float(i), 0.0, i, "A") for i in range(150)]


def test_edits_converge_in_any_order_and_repeated(spark):
    rows = edits()
    want = replayed(rows)
    assert [v for v, _, _ in want[1]] == ["v1", "v2", "v4"] and want[1][0][1:] == (8.0, 8.0) and len(want[4]) == 150
    for seed in (1, 2):
        again = rows + rows[::3]
        random.Random(seed).shuffle(again)
        assert rings(editlog.replay_geometry(spark.createDataFrame(again, OPS))) == want
    assert editlog.replay_geometry(spark.createDataFrame([], OPS)).count() == 0


def test_live_geometry_equals_replay_after_a_restart(spark, tmp_path):
    rows, source, out = edits(200, 7), str(tmp_path / "in"), str(tmp_path / "out")
    random.Random(3).shuffle(rows)
    (tmp_path / "in").mkdir()
    ops = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(source)
    for part in range(2):
        half = rows[part::2] + rows[::5]
        spark.createDataFrame(half, OPS).repartition(2).write.mode("append").parquet(source)
        feed = live.live_geometry(ops).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c"))
        feed.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    assert rings(editlog.ring_order(spark.read.parquet(out))) == replayed(rows)


def test_live_presence_equals_its_batch_twin(spark, tmp_path):
    start, source, out = dt.datetime(2024, 1, 1), str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    rng = random.Random(5)
    rows = [(rng.choice(["d", "e"]), rng.randrange(3), start + dt.timedelta(seconds=rng.randrange(1500))) for _ in range(120)] + [("d", 0, start), ("d", 0, start + dt.timedelta(seconds=30)), ("d", 0, start + dt.timedelta(seconds=60, milliseconds=1))]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(50)))  # up to 50 s late
    cursors = spark.readStream.schema("doc string, actor int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    steps = [rows[i : i + 30] for i in range(0, len(rows), 30)] + [[("z", 9, start + dt.timedelta(hours=2))], [("z", 9, start + dt.timedelta(hours=3))]]
    for step in steps:  # a stop and a restart between any two
        spark.createDataFrame(step, "doc string, actor int, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        query = live.live_presence(cursors, 30_000, "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    every = spark.createDataFrame(rows, "doc string, actor int, ts timestamp")
    want = sorted(map(tuple, editlog.presence_events(every).collect()))
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("doc != 'z'").select("doc", "actor", "event", "ts").collect())
    assert got == want and len(want) > 40


def test_lines_of_known_length(spark):
    known = [
        ("Flinders Peak to Buninyong", 144.424867888889, -37.951033416667, 143.926495527778, -37.652821138889, 54972.271, 306.868158333),
        ("New York to London", -73.8, 40.6, -0.5, 51.6, 5551759.400, 51.198882846),
        ("a degree of the equator", 0.0, 0.0, 1.0, 0.0, 111319.491, 90.0),
        ("over the date line", 179.5, 10.0, -179.5, 10.0, 109639.322, 89.913172),
    ]
    for name, lon1, lat1, lon2, lat2, distance, bearing in known:
        row = spark.range(1).select(geodesics.geodesic_inverse(*map(F.lit, (lon1, lat1, lon2, lat2))).alias("g")).first().g
        assert abs(row.distance - distance) < 2e-3 and abs(row.bearing - bearing) < 1e-5, (name, row)
    same, opposite = (spark.range(1).select(geodesics.geodesic_inverse(*map(F.lit, x)).alias("g")).first().g for x in ((3.0, 40.0, 3.0, 40.0), (0.0, 0.0, 179.9, 0.1)))
    assert tuple(same) == (0.0, 0.0, 180.0) and (opposite is None or opposite.distance is None)


def test_forward_and_inverse_agree(spark):
    rows = [(float(lon), float(lat), float(az), float(d)) for lon in (-179, -30, 100) for lat in (-89, -45, 0, 60) for az in (0, 1, 90, 215, 359) for d in (0.5, 1e3, 1e6, 1.5e7)]
    df = spark.createDataFrame(rows, "lon double, lat double, az double, d double").withColumn("f", geodesics.geodesic_forward(F.col("lon"), F.col("lat"), F.col("az"), F.col("d")))
    back = df.withColumn("g", geodesics.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("f.lon"), F.col("f.lat"))).collect()
    for r in back:
        turned = (r.g.bearing - r.az + 180) % 360 - 180
        assert abs(r.g.distance - r.d) < 1e-3 and abs(math.radians(turned) * math.sin(r.d / 6.37e6)) * 6.37e6 < 1e-3, r


@pytest.mark.parametrize("block", [256, 2])
def test_geodesic_traverse(spark, block):
    legs = spark.createDataFrame([(1, i, 90.0 * i, 1000.0) for i in range(5)] + [(2, 0, 45.0, 10.0), (3, 0, 1.0, 1.0)], "t int, seq int, bearing double, d double")
    starts = spark.createDataFrame([(1, -97.0, 30.0), (2, 5.0, -40.0)], "t int, lon double, lat double")
    points = geodetic.geodesic_traverse(legs, starts, block)
    got = {(r.t, r.seq): r for r in points.collect()}
    lon, lat = -97.0, 30.0
    for i in range(5):
        end = spark.range(1).select(geodesics.geodesic_forward(*map(F.lit, (lon, lat, 90.0 * i, 1000.0))).alias("g")).first().g
        lon, lat = end.lon, end.lat
        assert abs(got[1, i].lon - lon) < 1e-12 and abs(got[1, i].lat - lat) < 1e-12 and got[1, i].run == 1000.0 * (i + 1)
    assert set(got) == {(1, i) for i in range(5)} | {(2, 0)}
    closure = {r.t: r for r in geodetic.geodesic_closure(points, starts).collect()}
    assert abs(closure[1].closure - 1000) < 0.2 and closure[2].ratio == pytest.approx(1.0) and closure[2].bearing == pytest.approx(225.0, abs=1e-3)
    fixed = {(r.t, r.seq): r for r in geodetic.adjust_geodesic(points, starts).collect()}
    assert fixed[1, 4].lon == pytest.approx(-97.0, abs=1e-12) and fixed[1, 4].lat == pytest.approx(30.0, abs=1e-12)
    assert geodetic.geodesic_traverse(legs.limit(0), starts).count() == 0


def test_traverses_are_walked_side_by_side(spark):
    """As many lines by expressions, legs over several Arrow batches, and no job before the result is asked for."""
    rng = random.Random(4)
    legs = [(t, i, rng.uniform(0, 360), rng.choice([0.0, 0.5, 3e3, 2e6])) for t in range(40) for i in range(t % 9)] + [(99, i, float(i), 10.0 if i != 3 else None) for i in range(6)]
    starts = {t: (rng.uniform(-180, 180), rng.uniform(-80, 80)) for t in (*range(40), 99)}
    frame = spark.createDataFrame(legs, "t int, seq int, bearing double, d double").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "walk")
    points = geodetic.geodesic_traverse(frame, spark.createDataFrame([(t, *p) for t, p in starts.items()], "t int, lon double, lat double"), 7)
    assert not tracker.getJobIdsForGroup("walk")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got, at, run = {(r.t, r.seq): r for r in points.collect()}, dict(starts), dict.fromkeys(starts, 0.0)
    assert len(got) == len(legs)
    for k in range(9):
        now = [(t, *at[t], b, d) for t, i, b, d in legs if i == k and t != 99]
        ends = spark.createDataFrame(now, "t int, lon double, lat double, b double, d double").select("t", "d", geodesics.geodesic_forward(F.col("lon"), F.col("lat"), F.col("b"), F.col("d")).alias("g")).collect() if now else []
        for t, d, end in ends:
            at[t], run[t] = (end.lon, end.lat), run[t] + d
            assert abs(got[t, k].lon - end.lon) < 1e-10 and abs(got[t, k].lat - end.lat) < 1e-10 and got[t, k].run == run[t]
    assert got[99, 2].lon is not None and [got[99, i].lon for i in (3, 4, 5)] == [None] * 3 == [got[99, i].run for i in (3, 4, 5)]


def test_many_lines_at_once_are_those_of_expressions(spark):
    rng = random.Random(6)
    rows = [(rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)] + [(3.0, 40.0, 3.0, 40.0), (0.0, 0.0, 179.9, 0.1), (179.9, 1.0, -179.9, 1.0), (0.0, 0.0, 1.0, 0.0), (5.0, 10.0, 5.0000001, 10.0)]
    want = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geodesics.geodesic_inverse(*map(F.col, "abcd")).alias("g")).collect()
    for r, distance, bearing in zip(want, *geodesics.inverse_arrays(*np.array(rows).T), strict=True):
        if r.g is None or r.g.distance is None:
            assert math.isnan(distance) and math.isnan(bearing)
        else:
            assert abs(r.g.distance - distance) < 1e-6 and abs((r.g.bearing - bearing + 180) % 360 - 180) < 1e-6


def test_sun_windows_are_dealt_before_they_are_sampled(spark):
    from cadastre.operators import places

    sites = spark.range(8).selectExpr("id", "id * 10D as lon", "40D as lat", "timestamp'2026-06-21 00:00:00 UTC' as since", "timestamp'2026-06-22 00:00:00 UTC' as until")
    plan = places.sun_windows(sites, 30, 30.0, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and plan.index("posexplode") < plan.index("Exchange hashpartitioning(id")


def test_strip_centres_are_not_sent(spark):
    from cadastre.operators import easements

    corner = lambda x, y: {"x": x, "y": y}
    point = "struct<x:double,y:double>"
    lines = spark.createDataFrame([(1, [corner(-7.0, -3.0), corner(95.0, 61.0)], 8.0), (2, [corner(0.0, 50.0), corner(90.0, 10.0)], 6.0)], f"id int, centerline array<{point}>, width_m double")
    parcels = spark.createDataFrame([(1, [corner(-50.0, -50.0), corner(150.0, -50.0), corner(150.0, 150.0), corner(-50.0, 150.0), corner(-50.0, -50.0)]), (2, [corner(0.0, 0.0), corner(60.0, 0.0), corner(0.0, 60.0), corner(0.0, 0.0)])], f"id int, ring array<{point}>")
    net = easements.encumbered_area_net(parcels, lines, 0.7, 40.0)
    assert net._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(cx") == 1  # the parcels
    # Both rings hold a cell's centre or not by themselves: the same over every cell of the plane.
    rings_of = [[(p.x, p.y) for p in r.ring] for r in easements.segments(lines).collect()]
    held = lambda ring, x, y: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1
    centres = [((i + 0.5) * 0.7, (j + 0.5) * 0.7) for i in range(-30, 170) for j in range(-30, 120)]
    centres = [(x, y) for x, y in centres if any(held(r, x, y) for r in rings_of)]
    want = {r.id: sum(held([(p.x, p.y) for p in r.ring], x, y) for x, y in centres) * 0.7 * 0.7 for r in parcels.collect()}
    assert {r.parcel: round(r.area, 6) for r in net.collect()} == {k: round(v, 6) for k, v in want.items()}

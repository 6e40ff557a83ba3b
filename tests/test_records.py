"""Goldens of title items, field codes, replies, lot design and fabric moves."""

import hashlib
import json
import math

import pytest

from cadastre.operators import deeds, design, documents, fabric, title


def test_title_items(spark):
    rows = [(1, "B1", "Release of LIEN by the bank"), (1, "B2", "Access easement; egress"), (1, "B2", "Deed of Trust recorded in Book 12, page 3"), (2, "B1", "unclear"), (2, "B2", None)]
    items = documents.classify_items(spark.createDataFrame(rows, "doc int, schedule string, text string"))
    assert [r.kind for r in items.collect()] == ["lien_release", "access_easement", "mortgage", "other", None]
    assert {r.doc: r.score for r in documents.title_risk_score(items).collect()} == {1: 21, 2: 3}
    assert [r.recording_ref for r in documents.recording_refs(items).collect()] == [None, None, "Book 12", None, None]


def test_field_codes(spark):
    shots = spark.createDataFrame([("a", 1, "+EOP1, BC // TOE"), ("a", 2, "eop1 12x"), ("a", 3, "ENDEOP1"), ("a", 4, "EOP1"), ("a", 5, None), ("a", 6, " // no")], "crew string, pos int, raw string")
    codes = documents.parse_field_codes(shots)
    got = [(r.pos, r.code, r.number, r.opens, r.closes, r.curve_begins) for r in codes.orderBy("pos", "seq").collect()]
    assert got == [(1, "EOP", 1, True, False, False), (1, "BC", None, False, False, True), (2, "EOP", 1, False, False, False), (3, "EOP", 1, False, True, False), (4, "EOP", 1, False, False, False)]
    assert sorted((r.code, r.n, r.begins, r.ends) for r in documents.feature_runs(codes).collect()) == [("BC", 1, 1, 1), ("EOP", 1, 4, 4), ("EOP", 3, 1, 3)]
    book = spark.createDataFrame([("eop", "line", "ROAD")], "code string, kind string, layer string")
    own = spark.createDataFrame([("EOP", "breakline", "OWN")], book.schema)
    assert {(r.code, r.kind, r.layer) for r in documents.codebook_join(codes, book).collect()} == {("EOP", "line", "ROAD"), ("BC", "point", "FIELD-UNKNOWN")}
    assert documents.codebook_join(codes, book, own).where("layer = 'OWN'").count() == 4


def test_replies(spark):
    rows = [('```json\n{"a": 1}\n```',), ("none",), ("} {",), ("{broken}",), (None,)]
    got = documents.json_from_completion(spark.createDataFrame(rows, "text string")).collect()
    assert [(r.json, r.valid) for r in got] == [('{"a": 1}', True), (None, False), (None, False), ("{broken}", False), (None, False)]


def test_strip_of_lots(spark):
    parcels = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 20.0), (2, 0.0, 0.0, 100.0, 5.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    lots = design.design_strip(parcels, 10.0, 10.0, 500.0)
    assert [(r.lot, r.x0, r.x1) for r in lots.orderBy("lot").collect()] == [(1, 0.0, 25.0), (2, 25.0, 50.0), (3, 50.0, 75.0), (4, 75.0, 100.0)]
    (total,) = design.design_totals(lots, parcels).collect()
    assert (total.id, total.lots, total.lot_area, total.density) == (1, 4, 2000.0, 0.002)


def test_geojson(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], math.inf, None)]
    (r,) = design.to_geojson(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, a double, b string"), ["a", "b"]).collect()
    feature = json.loads(r.feature)
    assert feature["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]} and not feature.get("properties")


def test_moves(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 10.0, 0.0)], "id int, x double, y double")
    controls = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (2, 10.0, 0.0, 10.0, 4.0)], "ord int, sx double, sy double, tx double, ty double")
    assert sorted(tuple(r) for r in fabric.rubber_sheet(nodes, controls).collect()) == [(1, 0.0, 2.0), (2, 5.0, 3.0), (3, 10.0, 4.0)]
    assert sorted(tuple(r) for r in fabric.rubber_sheet(nodes, controls.limit(0)).collect()) == sorted(tuple(r) for r in nodes.collect())
    assert sorted(tuple(r) for r in fabric.move_nodes(nodes, nodes.where("id = 2").selectExpr("id", "9D as x", "y")).collect()) == [(1, 0.0, 0.0), (2, 9.0, 0.0), (3, 10.0, 0.0)]
    with pytest.raises(ValueError):
        fabric.rubber_sheet(nodes, controls, power=0)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "survey int, name string, version int")
    incoming = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (2, "a", 1)], target.schema)
    assert sorted(tuple(r) for r in title.upsert_parcels(target, incoming).collect()) == [(1, "a", 3), (1, "b", 1), (2, "a", 1)]


def test_deed_boundary(spark):
    calls = spark.createDataFrame([(1, i, math.radians(90 * i), 10.0) for i in range(4)] + [(2, 0, None, 5.0), (2, 1, 0.0, 5.0), (3, 0, 0.0, 4.0)], "doc int, seq int, az double, metres double")
    square, line = deeds.deed_boundaries(calls).orderBy("doc").collect()
    assert (square.doc, square.n, square.perimeter, square.ratio) == (1, 4, 40.0, None) and square.misclosure < 1e-9
    assert [(round(p.x, 6) + 0.0, round(p.y, 6) + 0.0) for p in square.ring] == [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    assert (line.doc, line.misclosure, line.ratio) == (3, 4.0, 1.0)


def test_tracts(spark):
    rows = [(1, "Preamble\nTract 1: a field\nPARCEL B - a wood\nLess and except the barn, RESERVING UNTO seller " + "x" * 900), (2, "All the land save and except the well"), (3, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc int, text string")
    parts = deeds.split_tracts(docs)
    got = [(r.doc, r.role) for r in parts.orderBy("doc", "pos").collect()]
    assert got == [(1, "parent"), (1, "additional"), (1, "exception"), (1, "reservation"), (2, "parent"), (2, "exception")]
    assert len(parts.where("role = 'reservation'").first().part) == deeds.RESERVED_MOST
    assert [tuple(r)[1:] for r in deeds.deed_flags(docs).orderBy("doc").collect()] == [(False, True, True), (False, True, False), (False, False, False), (False, False, False)]
    areas = spark.createDataFrame([(1, "parent", 9.0), (1, "exception", 4.0), (1, "additional", 7.0), (2, "parent", 1.0), (2, "exception", 4.0)], "doc int, role string, area double")
    assert {r.doc: r.net for r in deeds.net_area(areas).collect()} == {1: 5.0, 2: 0.0}


def test_training_pairs(spark):
    docs = spark.createDataFrame([(1, "Thence N 10° E 5 feet"), (2, "nothing")], "doc int, text string")
    (pair,) = deeds.training_pairs(docs, deeds.parse_deeds(docs)).collect()
    (call,) = json.loads(pair.target)
    assert pair.doc == 1 and pair.id == hashlib.sha256(pair.text.encode()).hexdigest()[:16] and call["kind"] == "line" and math.isclose(call["metres"], 1.524)


def test_file_fingerprints(spark, tmp_path):
    import hashlib

    from cadastre.sources.tables import file_fingerprints

    (tmp_path / "sub").mkdir()
    files = {tmp_path / "a.txt": b"", tmp_path / "sub" / "b b.txt": bytes(range(256)) * 5000, tmp_path / "c.dat": b"x"}
    for path, data in files.items():
        path.write_bytes(data)
    got = {(r.path.rsplit("/", 1)[-1].replace("%20", " "), r.size): r.hash for r in file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {(p.name, len(d)): hashlib.sha256(d).hexdigest() for p, d in files.items() if d}
    assert file_fingerprints(spark, str(tmp_path), "*.dat").count() == 1


def test_ranks_over_ranges(spark):
    """One group holds most rows; its ranges' places join up."""
    from cadastre.operators.ranks import ranked

    rows = [("hot", (i * 7919) % 10_007, i) for i in range(3000)] + [(None, i, -i) for i in range(5)] + [("b", 3, 1), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {(r.g, r.o): r.place for r in ranked(df, "g", ["o"], "place").collect()}
    want = {(g, o): i for g in ("hot", None, "b") for i, o in enumerate(sorted(o for h, o, _ in rows if h == g))}
    assert got == want and ranked(df.limit(0), "g", ["o"]).count() == 0


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """Files above a size are read by many tasks and hashed in order: whatever their bytes, none is lost."""
    import hashlib
    import random

    from cadastre.sources import tables

    rng, mark = random.Random(4), b"\xef\xbb\xbf"
    files = {"small.dat": b"abc\n", "not packed.gz": b"no gzip", "lines.dat": b"a line\r\n" * 60, "no end.dat": b"x\n" * 99 + b"y", "feeds.dat": b"\n" * 333, "one.dat": b"z" * 500, "mark.dat": mark + b"first\nsecond" * 30, "marks.dat": mark + mark + b"\n" + mark * 50 + b"\n", "noise.dat": rng.randbytes(200_000), "sub/noise.dat": bytes(rng.choices((0, 10, 13, 255), k=5000))}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(tables, "WHOLE", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        found = tables.file_fingerprints(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Scan text" in plan and "mapinarrow" in plan.lower()
        got = sorted((r.size, r.hash) for r in found.collect())
        assert got == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in files.values())
        assert tables.file_fingerprints(spark, str(tmp_path), "*noise.dat").count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

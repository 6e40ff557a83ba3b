"""Goldens of the survey operators, and all registered queries against their DuckDB SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cadastre.functions import rings
from cadastre.operators import editlog, title, traverse
from cadastre.operators import evidence as E
from cadastre.plans import easements, field, fieldfiles, filings, geodetic, land, networks, places, records, surfaces, topology  # noqa: F401
from cadastre.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def square(spark, last=100.0):
    rows = [(1, i + 1, math.radians(90 * i), 100.0 if i < 3 else last) for i in range(4)]
    return spark.createDataFrame(rows, "t long, seq int, az double, d double")


def test_square_closes(spark):
    row = traverse.traverse_closure(square(spark)).first()
    assert row.ratio is None and row.perimeter == 400 and abs(abs(row.area) - 10_000) < 1e-6


def test_adjustments_close_what_was_open(spark):
    report = {r.method: r for r in traverse.closure_report(square(spark, 100.05), 100_000).collect()}
    assert not report["unadjusted"].passes and report["compass"].passes and report["transit"].passes


def test_ring_metrics_and_clip(spark):
    def ring(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]

    rows = spark.createDataFrame([(ring(0.0, 0.0, 4.0), ring(2.0, 2.0, 4.0)[::-1]), (ring(0.0, 0.0, 4.0), ring(9.0, 9.0, 1.0))], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = rows.select(rings.signed_area(F.col("b")).alias("s"), F.coalesce(rings.signed_area(rings.clip(F.col("a"), F.col("b"))), F.lit(0.0)).alias("c")).collect()
    assert got[0].s == -16 and got[0].c == 4 and got[1].c == 0


def test_chain_defects(spark):
    rows = [(1, i, g, h, dt.date(y, 1, 1), str(i)) for i, (g, h, y) in enumerate((("US", "Alice", 1900), ("Alice", "Bob", 1925), ("Eve", "Bob", 1950), ("Bob", "bob, Jr.", 1995)))]
    links = spark.createDataFrame(rows, "parcel int, input_pos int, grantor string, grantee string, recorded date, instrument string")
    assert [r.input_pos for r in title.wild_deeds(links).collect()] == [2]
    assert [r.input_pos for r in title.title_gaps(links).collect()] == [3]
    assert [r.input_pos for r in title.self_conveyances(links).collect()] == [3]
    assert title.duplicate_instruments(links).count() == 0


def test_pin_beats_call(spark):
    rows = [(1, "artificial_monument_found", "TX", 0.0, 0.0, 0.02), (1, "deed_call_distance", "TX", 2.0, 0.0, 0.5)]
    found = spark.createDataFrame(rows, "corner int, kind string, state string, x double, y double, sigma double")
    assert E.determine_boundary(E.evidence_weights(found, E.state_rules(spark))).first().x < 0.01


def test_edit_log(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("d", "k", "v", "insert", "a", at(1), 1.0, 1.0, "x"), ("d", "k", "v", "move", "b", at(1), 2.0, 2.0, "y"), ("d", "k", "w", "insert", "a", at(2), 3.0, 3.0, "z"), ("d", "k", "w", "delete", "a", at(1), 0.0, 0.0, "q")]
    ops = spark.createDataFrame(rows, "doc string, key string, vertex string, kind string, actor string, ts timestamp, x double, y double, value string")
    assert editlog.lww_merge(ops).first().value == "z"
    assert [tuple(r) for r in editlog.vertex_state(ops).collect()] == [("d", "v", 2.0, 2.0)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([float(v) if type(v).__name__ == "Decimal" else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain([r[c] for c in columns] for r in df.collect()) == plain([r[i] for i in at] for r in result.fetchall())


def test_boundary_does_not_hang_on_the_order_of_evidence(spark):
    rows = [(1, 100.0 + i * 0.37, 200.0 + i * 0.011, 0.01 + i % 7 / 100, 1.0 / (3 + i % 5)) for i in range(40)]
    kinds = "corner int, x double, y double, sigma double, w double"
    got = [tuple(E.determine_boundary(spark.createDataFrame(own, kinds).coalesce(1)).first()) for own in (rows, rows[::-1], rows[1::2] + rows[::2], sorted(rows, key=lambda r: r[4]))]
    assert len(set(got)) == 1 and 0 < got[0][2] <= 40

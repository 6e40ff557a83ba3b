"""Queries of title commitments, plats and certificates, written from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.operators import filings
from cadastre.plans.registry import query
from cadastre.sources.tables import load

_K = "o_orderkey"
#: One text in both dialects: || and chr() are the same in Spark and DuckDB.
_COMMITMENT = """'COMMITMENT' || chr(10) || CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'Schedule A' || chr(10) END || 'Effective Date: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'January 5, 2024' ELSE '12/31/2023' END || chr(10) || 'Proposed Insured: Owner '
 || CAST(o_custkey AS VARCHAR(20)) || chr(10) || 'Title is vested in: Seller ' || CAST(o_orderkey % 17 AS VARCHAR(20)) || chr(10) || 'a ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Fee Simple' ELSE 'leasehold' END || ' estate, policy of $ 1,' || CAST(100 + o_orderkey % 900 AS VARCHAR(20)) || '.50' || chr(10)
 || 'Legal Description: Lot ' || CAST(o_custkey AS VARCHAR(20)) || chr(10)"""
_ITEMS = """ || 'SCHEDULE B-I REQUIREMENTS' || chr(10) || '1. Release of lien' || chr(10) || ' to Bank ' || CAST(o_custkey AS VARCHAR(20)) || chr(10) || '2. x' || chr(10) || 'SCHEDULE B - II: EXCEPTIONS' || chr(10) || '(a) Utility easement recorded in Book ' || CAST(o_orderkey AS VARCHAR(20)) || chr(10) || 'b. Mineral reservation of ' || CAST(o_custkey AS VARCHAR(20))"""


def _commitments(spark, sf_dir) -> DataFrame:
    text = _COMMITMENT + " || CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE ''" + _ITEMS + " END"
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey as doc", f"{text} as text")


@query(
    "parse_schedule_a",
    "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2024-01-05' ELSE DATE '2023-12-31' END AS effective, 'Owner ' || o_custkey AS insured, 'Seller ' || o_orderkey % 17 AS vested, 'Lot ' || o_custkey AS legal, CASE WHEN o_orderkey % 2 = 0 THEN 'fee_simple' ELSE 'leasehold' END AS estate, 1100.5::DOUBLE + o_orderkey % 900 AS amount FROM orders",
)
def parse_schedule_a(spark, sf_dir) -> DataFrame:
    return filings.parse_schedule_a(_commitments(spark, sf_dir))


@query(
    "commitment_items",
    """SELECT o_orderkey AS doc, 'B1' AS schedule, '1.' AS number, 'Release of lien to Bank ' || o_custkey AS text, 'lien_release' AS kind, NULL AS recording_ref FROM orders WHERE o_orderkey % 8 > 0
UNION ALL SELECT o_orderkey, 'B2', '(a)', 'Utility easement recorded in Book ' || o_orderkey, 'utility_easement', 'Book ' || o_orderkey FROM orders WHERE o_orderkey % 8 > 0 UNION ALL SELECT o_orderkey, 'B2', 'b.', 'Mineral reservation of ' || o_custkey, 'mineral_reservation', NULL FROM orders WHERE o_orderkey % 8 > 0""",
)
def commitment_items(spark, sf_dir) -> DataFrame:
    return filings.commitment_items(_commitments(spark, sf_dir)).select("doc", "schedule", "number", "text", "kind", "recording_ref")


_PLAT = """'Plat of Sunset Ridge ' || CAST(o_orderkey % 9 AS VARCHAR(20)) || ', as recorded in Cabinet ' || CAST(o_custkey AS VARCHAR(20)) || ' of the records. Lot ' || CAST(o_orderkey % 50 AS VARCHAR(20)) || ', Block A is a corner lot. Lot 7B, Block ' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'C' END
 || ' and Lot 7B, Block A again. Block D is kept. Sunset Ridge Drive is a ' || CAST(30 + o_orderkey % 40 AS VARCHAR(20)) || '-foot wide way; Oak Lane has no width. Sunset Ridge Drive goes on 12 m. ' || CASE WHEN o_orderkey % 3 = 0 THEN 'A Detention Pond and a park' ELSE 'Open Space' END || ' are shown.'"""


def _plats(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey as doc", f"{_PLAT} as text")


@query("plat_names", "SELECT o_orderkey AS doc, 'Sunset Ridge ' || o_orderkey % 9 AS name, 'Cabinet ' || o_custkey AS recording FROM orders")
def plat_names(spark, sf_dir) -> DataFrame:
    return filings.plat_names(_plats(spark, sf_dir))


_LOTS = "SELECT o_orderkey AS doc, (o_orderkey % 50)::VARCHAR AS number, 'A' AS block FROM orders UNION SELECT o_orderkey, '7B', 'A' FROM orders UNION SELECT o_orderkey, '7B', 'C' FROM orders WHERE o_orderkey % 2 = 1"


@query("parse_plats", f"SELECT doc, number, block FROM ({_LOTS})")
def parse_plats(spark, sf_dir) -> DataFrame:
    return filings.plat_lots(_plats(spark, sf_dir)).select("doc", "number", "block")


@query("plat_streets", "SELECT o_orderkey AS doc, 'Sunset Ridge Drive' AS name, round((30 + o_orderkey % 40) * 0.3048, 6)::DOUBLE AS width_m FROM orders UNION ALL SELECT o_orderkey, 'Oak Lane', 12.0 FROM orders")
def plat_streets(spark, sf_dir) -> DataFrame:
    return filings.plat_streets(_plats(spark, sf_dir)).withColumn("width_m", F.round("width_m", 6))


@query("plat_common_areas", "SELECT o_orderkey AS doc, label, kind FROM orders JOIN (VALUES ('Detention Pond', 'drainage', true), ('Park', 'park', true), ('Open Space', 'common_area', false)) v(label, kind, pond) ON pond = (o_orderkey % 3 = 0)")
def plat_common_areas(spark, sf_dir) -> DataFrame:
    return filings.plat_common_areas(_plats(spark, sf_dir))


@query("plat_block_counts", f"SELECT doc, block, count(*) AS lots FROM ({_LOTS}) GROUP BY doc, block UNION ALL SELECT o_orderkey, 'D', 0 FROM orders")
def plat_block_counts(spark, sf_dir) -> DataFrame:
    return filings.plat_block_counts(_plats(spark, sf_dir))


_CERTS = """certs AS (SELECT o_orderkey AS cert_id, ['alta_nsps', 'elevation', 'boundary'][1 + o_orderkey % 3] AS type, ['TX', 'CA', 'ny'][1 + o_custkey % 3] AS license_state, ['TX', 'CA', 'WY', 'NY'][1 + o_orderkey % 4] AS state, o_orderdate::DATE + (o_custkey % 60 - 10)::INTEGER AS license_exp,
 o_orderdate::DATE AS issue, o_orderdate::DATE + (o_orderkey % 20 - 15)::INTEGER AS field_end, CASE WHEN o_orderkey % 6 > 3 THEN 'AE' END AS flood_zone, CASE WHEN o_custkey % 2 = 0 THEN 'A' END AS accuracy, o_custkey % 5 AS c, o_orderkey % 7 AS m FROM orders)"""


def _certs(spark, sf_dir) -> DataFrame:
    pick = lambda values, i: f"element_at(array({', '.join(map(repr, values))}), cast(1 + {i} as int))"
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as cert_id", f"{pick(('alta_nsps', 'elevation', 'boundary'), 'o_orderkey % 3')} as type", f"{pick(('TX', 'CA', 'ny'), 'o_custkey % 3')} as license_state", f"{pick(('TX', 'CA', 'WY', 'NY'), 'o_orderkey % 4')} as state",
        "date_add(cast(o_orderdate as date), cast(o_custkey % 60 - 10 as int)) as license_exp", "cast(o_orderdate as date) as issue", "date_add(cast(o_orderdate as date), cast(o_orderkey % 20 - 15 as int)) as field_end",
        "if(o_orderkey % 6 > 3, 'AE', null) as flood_zone", "if(o_custkey % 2 = 0, 'A', null) as accuracy", "if(o_custkey % 5 = 0, array('1', '6a'), cast(array() as array<string>)) as alta_items", "if(o_orderkey % 7 = 0, array('1', '2', '11', '2'), array('1')) as required",
    )


@query(
    "validate_certificates",
    f"""WITH {_CERTS} SELECT cert_id, 'warning' AS severity, 'licensed in another state' AS issue FROM certs WHERE upper(license_state) <> state UNION ALL SELECT cert_id, 'error', 'licence expired before issue' FROM certs WHERE license_exp < issue
UNION ALL SELECT cert_id, 'error', 'field work after issue' FROM certs WHERE field_end > issue UNION ALL SELECT cert_id, 'warning', 'no accuracy class' FROM certs WHERE type = 'alta_nsps' AND accuracy IS NULL
UNION ALL SELECT cert_id, 'error', 'Table A items on another certificate' FROM certs WHERE type <> 'alta_nsps' AND c = 0 UNION ALL SELECT cert_id, 'error', 'no flood zone' FROM certs WHERE type = 'elevation' AND flood_zone IS NULL
UNION ALL SELECT cert_id, 'warning', 'no statutory text for the state' FROM certs WHERE state = 'WY'""",
)
def validate_certificates(spark, sf_dir) -> DataFrame:
    return filings.validate_certificates(_certs(spark, sf_dir), ["TX", "CA", "NY"])


@query(
    "alta_missing_items",
    f"WITH {_CERTS}, need AS (SELECT cert_id, item, c FROM certs, (VALUES ('1', true), ('2', false), ('11', false)) v(item, always) WHERE type = 'alta_nsps' AND (always OR m = 0)) SELECT cert_id, item AS missing FROM need WHERE NOT (c = 0 AND item = '1') UNION ALL SELECT cert_id, NULL FROM certs WHERE type <> 'alta_nsps'",
)
def alta_missing_items(spark, sf_dir) -> DataFrame:
    return filings.alta_missing_items(_certs(spark, sf_dir))

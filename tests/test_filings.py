"""Goldens of commitments, plats and certificates."""

import datetime as dt

from cadastre.operators import filings

TEXT = """COMMITMENT
SCHEDULE A
Effective Date: March 3, 2023
Proposed Insured: Jane Roe
Title is vested in: John Doe
Fee simple, amount $ 1,250,000.00
Legal Description: Lot 1
SCHEDULE B, PART I - REQUIREMENTS
1. Release of lien
   to the bank.
(b) no
SCHEDULE B-II EXCEPTIONS
1. Taxes for 2023.
a. Easement, Instrument No. 12345/6; more
"""


def test_commitment(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "nothing")], "doc int, text string")
    a = {r.doc: r for r in filings.parse_schedule_a(docs).collect()}
    assert (a[1].effective, a[1].insured, a[1].vested, a[1].legal, a[1].estate, a[1].amount) == (dt.date(2023, 3, 3), "Jane Roe", "John Doe", "Lot 1", "fee_simple", 1_250_000.0)
    assert a[3].insured is None and a[2].amount is None
    items = filings.commitment_items(docs).orderBy("schedule", "pos").collect()
    assert [(r.schedule, r.number, r.text, r.recording_ref) for r in items] == [("B1", "1.", "Release of lien to the bank.", None), ("B2", "1.", "Taxes for 2023.", None), ("B2", "a.", "Easement, Instrument No. 12345/6; more", "12345/6")]


def test_dates_and_headings(spark):
    said = ["Jan 5, 2024", "1/5/24", "January 5 2024", "12/31/1999", "Sept. 9, 98", "no date", "13/45/2020"]
    docs = spark.createDataFrame([(i, f"Schedule A\r\nEffective date {t}\r\nSCHEDULE B - EXCEPTIONS\r\n1. Nothing here\r\nsee Schedule A\r\n") for i, t in enumerate(said)], "doc int, text string")
    got = {r.doc: r.effective for r in filings.parse_schedule_a(docs).collect()}
    assert list(map(got.get, range(7))) == [dt.date(2024, 1, 5)] * 3 + [dt.date(1999, 12, 31), dt.date(1998, 9, 9), None, None]
    assert {r.text for r in filings.commitment_items(docs).collect()} == {"Nothing here see Schedule A"}


def test_many_sections(spark):
    text = "Schedule B Requirements\n" * 1500 + "SCHEDULE B EXCEPTIONS\n1. A long way down"
    assert [r.text for r in filings.commitment_items(spark.createDataFrame([(1, text)], "doc int, text string")).collect()] == ["A long way down"]


def test_plat(spark):
    text = "Plat of Sunset Ridge, as recorded in Cabinet C of the records. Lot 1, Block A is here. Lot 2, Block A too. Lot 3, Block B and Lot 3, Block B again. Block Z stays empty. Sunset Ridge Drive is a 60-foot wide right-of-way."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    assert filings.plat_names(docs).where("doc = 1").first()[1:] == ("Sunset Ridge", "Cabinet C")
    assert sorted((r.number, r.block) for r in filings.plat_lots(docs).collect()) == [("1", "A"), ("2", "A"), ("3", "B")]
    assert [(r.name, round(r.width_m, 3)) for r in filings.plat_streets(docs).collect()] == [("Sunset Ridge Drive", 18.288)]
    assert {(r.block, r.lots) for r in filings.plat_block_counts(docs).collect()} == {("A", 2), ("B", 1), ("Z", 0)}


def test_certificates(spark):
    d = dt.date(2024, 5, 1)
    schema = "cert_id int, type string, license_state string, license_exp date, state string, issue date, field_end date, flood_zone string, accuracy string, alta_items array<string>, required array<string>"
    rows = [(1, "alta_nsps", "TX", None, "tx", d, None, None, "A", ["1"], ["1", "11"]), (2, "boundary", "CA", dt.date(2024, 4, 1), "TX", d, dt.date(2024, 6, 1), None, None, ["1"], None), (3, "elevation", "WY", None, "WY", d, d, None, None, None, None)]
    certs = spark.createDataFrame(rows, schema)
    issues = filings.validate_certificates(certs, ["TX", "CA"])
    assert {i: issues.where(f"cert_id = {i}").count() for i in (1, 2, 3)} == {1: 0, 2: 4, 3: 2}
    assert {(r.cert_id, r.missing) for r in filings.alta_missing_items(certs).collect()} == {(1, "11"), (2, None), (3, None)}


def test_streets_of_long_texts_stay_in_their_row(spark):
    text = "of the Old Mill. Old Mill Road, 40 ft wide. " + "Lot 1 by word " * 2000 + "North Way Court is 9 m. old mill Road ends at Way St Drive"
    streets = filings.plat_streets(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Elm, Street Ash Lane")], "doc int, text string"))
    plan = streets._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "words" not in plan[plan.index("Exchange") : plan.index("Exchange") + 200]
    assert {(r.doc, r.name, r.width_m and round(r.width_m, 3)) for r in streets.collect()} == {(1, "Old Mill Road", 12.192), (1, "North Way Court", 9.0), (1, "Way St Drive", None), (4, "Street Ash Lane", None)}

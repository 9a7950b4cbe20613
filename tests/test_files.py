"""Readers and writers on files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from conftest import DATA

from chargeaudit.functions import extract as E
from chargeaudit.plans.sources import column_roles
from chargeaudit.sources import files as S


def test_parsed_bills(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bill_id": "1", "header": {"hospital_name": "H"}, "line_items": [{"description": "x", "amount": 2.5}, {"description": "y"}], "totals": {"extracted_gst": 1.0}}))
    (tmp_path / "b.json").write_text(json.dumps({"bill_id": "2", "line_items": []}))
    bills, lines = S.parsed_bills(spark, str(tmp_path))
    assert bills.count() == 2
    assert [(r.bill_id, r.pos, r.description, r.amount) for r in lines.orderBy("pos").collect()] == [("1", 0, "x", 2.5), ("1", 1, "y", None)]


def test_uploads(spark, tmp_path):
    for name, size in (("a.PDF", 10), ("b.exe", 10), ("c.png", 100)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.suffix for r in S.uploads(spark, str(tmp_path), largest=50).collect()] == ["pdf"]


def test_price_lists_and_rules(spark, tmp_path):
    for name, data in (("entries.json", {"entries": [{"code": "a", "rate": 1}, {"code": "b", "rate": 2}]}), ("drugs.json", {"drugs": [{"code": "c"}]}), ("rules.json", {"rule": "x", "days": 3})):
        (tmp_path / name).write_text(json.dumps(data))
    (tmp_path / "broken.json").write_text("{")
    assert E.price_list(spark, str(tmp_path / "entries.json")).count() == 2
    assert [r.code for r in E.price_list(spark, str(tmp_path / "drugs.json")).collect()] == ["c"]
    default = spark.createDataFrame([("d", 15)], "rule string, days long")
    read = lambda n: tuple(E.rules_or(spark, str(tmp_path / n), default).first())
    assert read("rules.json") == ("x", 3) and read("missing.json") == ("d", 15) and read("broken.json") == ("d", 15)


def test_page_texts(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 3, "  "), (2, 1, None)]
    got = S.page_texts(spark.createDataFrame(rows, "doc_id int, page int, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 2, "a\nb", 3)]


def test_cells_shuffled_once(spark):
    """Headings told twice, by no column or in other documents, and cells under none; cells are shuffled once, and not at all if dealt by document."""
    rows = [
        (1, 0, 0, "Date"), (1, 0, 0, "Rate"), (1, 0, 1, "Item"), (1, 0, 2, "Notes"), (1, 0, None, "Amount"), (1, 1, 0, " 5 "), (1, 1, 1, None), (1, 1, None, "9"), (1, 2, 2, "x"), (1, None, 0, "y"), (1, -1, 0, "z"),
        (2, 1, 0, "lost"), (3, 0, 0, "Qty"), (3, 0, 1, "units"), (3, 1, 0, "1"), (3, 1, 1, "2"), (3, 1, 1, "10"), (None, 0, 0, "Qty"), (None, 1, 0, "1"),
    ]
    cells = spark.createDataFrame(rows, "doc_id long, row int, col int, text string")
    got = S.cells_to_rows(cells)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "5", None, None, "5", None), (3, 1, None, None, "2", None, None)]
    assert got.columns == ["doc_id", "row", "date", "description", "qty", "rate", "amount"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan(S.cells_to_rows(cells)).count("Exchange") == 1
    assert plan(S.cells_to_rows(cells.repartition(4, "doc_id"))).count("Exchange") == 1
    assert plan(column_roles(spark, DATA)).count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(doc_id" not in plan(column_roles(spark, DATA))


def test_columns_and_statuses(spark):
    cells = [(1, 0, i, t) for i, t in enumerate(["Particulars", "Amount (Rs)", "Remarks"])] + [(1, 1, 0, " Bed   day "), (1, 1, 1, "9"), (1, 1, 2, "x")]
    row = S.cells_to_rows(spark.createDataFrame(cells, "doc_id int, row int, col int, text string")).first()
    assert (row.description, row.amount, row.date) == ("Bed day", "9", None)
    said = spark.createDataFrame([("Payable up to",), ("It is payable",), ("Not Payable",), (None,)], "t string")
    assert [r[0] for r in said.select(S.payable_status(F.col("t"))).collect()] == ["payable", "conditionally_payable", "not_payable", "review_manually"]

"""Price checks by text on small tables, with and without prices."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import DATA

from chargeaudit.operators import matching as M
from chargeaudit.operators import pricing as P
from chargeaudit.plans import pricing as plans

LINE = "bill_id long, pos int, description string, amount decimal(12,2), code long"
PRICE = "name string, rate decimal(12,2)"


@pytest.fixture(scope="module")
def prices(spark):
    rows = [("Drug eluting stent", 30000), ("Bare metal stent", 9000), ("Knee implant system", 50000), ("Free stent drug", 0), (None, 5)]
    return spark.createDataFrame([(n, Decimal(r)) for n, r in rows], PRICE)


def lines(spark, *rows):
    return spark.createDataFrame([(1, i + 1, d, None if a is None else Decimal(a), None) for i, (d, a) in enumerate(rows)], LINE)


def found(df):
    return {r.pos: (r.matched, r.confidence) for r in df.collect()}


def test_drugs_take_the_nearest_entry_however_far(spark, prices):
    i = lines(spark, ("knee", 60001), ("knee", 60000), ("nothing", 99999), (None, 99999), ("knee", None))
    assert found(P.drug_ceilings(i, prices)) == {1: ("Knee implant system", "high")}


def test_devices_have_a_search_of_their_own(spark, prices):
    i = lines(spark, ("DES onyx", 31501), ("stent", 31500), ("knee implant", 52501), ("implant of some other kind", 99999), ("bare metal stent", 9500))
    out = P.device_ceilings(i, prices)
    assert found(out) == {1: ("Drug eluting stent", "high"), 3: ("Knee implant system", "high"), 2: ("Bare metal stent", "high"), 5: ("Bare metal stent", "high")}
    assert out.filter("pos = 1").first().evidence[-1] == "Found by the search for this device"


def test_labs(spark):
    b = spark.createDataFrame([("complete blood count", Decimal(100)), ("urea", Decimal(100))], PRICE)
    i = lines(spark, ("cbc", 151), ("urea", 501), ("urea", 500), ("urea serum level", 600), ("syringe", 900), ("mystery", 10), ("", 10), ("urea", 0), ("urea", 150))
    i = i.withColumn("expanded", F.when(F.col("description") == "cbc", "complete blood count"))
    out = P.lab_rates(i, b, ("expanded", "description"))
    assert found(out) == {1: ("complete blood count", "high"), 2: ("urea", "medium"), 3: ("urea", "high"), 4: ("urea", "medium"), 6: (None, "low")}
    assert out.filter("pos = 6").first().issue_type == "missing_itemization"


@pytest.mark.parametrize("check", [P.drug_ceilings, P.device_ceilings, lambda i, p: P.lab_rates(i, p, ("description",))])
def test_without_prices_or_lines(spark, prices, check):
    i = lines(spark, ("stent", 99999))
    with_prices = check(i, prices)
    assert check(i, None).count() == 0 and check(i, None).columns == with_prices.columns
    assert check(i.limit(0), prices).count() == 0
    assert check(i, prices.limit(0)).filter("benchmark IS NOT NULL").count() == 0


def test_labs_judge_texts_and_not_lines(spark):
    """Words are looked for in each different text, lines are read in one branch, and what runs over them is small enough for the JVM to compile (8000 bytes)."""
    b = spark.createDataFrame([("complete blood count", Decimal(100)), ("urea", Decimal(100))], PRICE)
    i = lines(spark, ("cbc", 151), ("syringe", 900), (None, 900), (" ", 900), ("mystery", 10), ("mystery", None), ("cbc", 150), ("cbc", 151))
    i = i.withColumn("expanded", F.when(F.col("description") != "mystery", "complete blood count"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = P.lab_rates(i, b, ("expanded",))
        plan = out._jdf.queryExecution().executedPlan()
        assert "syringe" not in plan.toString() and "Union" not in plan.toString()
        made = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$").codegenStringSeq(plans.lab_rates(spark, DATA)._jdf.queryExecution().executedPlan())
        assert 0 < max(made.apply(n)._3().maxMethodCodeSize() for n in range(made.size())) < 8000
        got = found(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {1: ("complete blood count", "high"), 5: (None, "low"), 8: ("complete blood count", "high")}
    assert [list(r.evidence) for r in out.sort("pos").collect()][:2] == [["Benchmark: ₹100.00", "Billed: ₹151.00", "Matched entry: complete blood count"], ["Billed: ₹10.00", "No reliable benchmark"]]


def test_evidence_leaves_out_what_says_nothing(spark):
    rows = spark.createDataFrame([("a", None, " "), (None, None, ""), (" a ", "b", "a")], "x string, y string, z string")
    assert [r.e for r in rows.select(M.evidence(F.col("x"), F.col("y"), F.col("z")).alias("e")).collect()] == [["a"], [], [" a ", "b", "a"]]

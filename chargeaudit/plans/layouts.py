"""Queries of page fields over texts whose layout changes from row to row: missing parts, broken lines, two of one field."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..sources.bridge import BRIDGE, bills


def _layouts(*texts):
    turn = F.col("bill_id") % len(texts)
    out = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        out = F.when(turn == i, t).otherwise(out)
    return out


def _bill(*parts):
    return F.concat(*[F.col("bill_id").cast("string") if p is None else F.lit(p) for p in parts])


def extract_headers(spark, d):
    """Hospital, ward, consultant and insurance of bills: names in capitals, names in a line that speaks of one, none, and nothing at all."""
    text = _layouts(
        _bill("CITY GENERAL HOSPITAL\nWard Type: General (AC) Discharge: today\nConsultant: Dr A", None, "  Insurance: Star ", None, "\n"),
        _bill("Bill ", None, "\nSunrise   Clinic of Pune\nconsultant: Dr B\nWARD TYPE: Private\nWard Type: Shared\n"),
        _bill("a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nA hospital in line eleven\nInsurance: Plan ", None, " CITY\n"),
        _bill("clinic\nMedical center no ", None, "\n\nConsultant:\nDr Of The Next Line\n"),
        F.lit(""),
        F.lit(None).cast("string"),
    )
    return X.headers(bills(spark, d).select(F.col("bill_id").alias("doc_id"), "bill_id").withColumn("text", text).drop("bill_id"))


def claim_letter_layouts(spark, d):
    """Claim letters in other orders and cases, with fields that are missing, doubled or on the next line."""
    text = _layouts(
        _bill("claim number: C/", None, "\npolicy holder: anna bee\n"),
        _bill("Policy Holder: Cy Dee\nNothing else, number ", None, "\n"),
        _bill("Claim Number: C/", None, "\nClaim Number: D/1\nPolicy Holder: Eve Fox\nPolicy Holder: Gil Hay\n"),
        _bill("Policy Holder:\nIda Jay\nClaim Number:\n  C/", None, "\n"),
        F.lit(None).cast("string"),
    )
    pages = bills(spark, d).select(F.col("bill_id").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    wanted = {k: X.CLAIM_FIELDS[k] for k in ("claim_number", "policy_holder")}
    return pages.select("doc_id", *X.fields(F.col("text"), wanted))


QUERIES = {f.__name__: f for f in (extract_headers, claim_letter_layouts)}
ORACLE_SQL = {
    "extract_headers": BRIDGE
    + """SELECT bill_id AS doc_id, CASE bill_id % 6 WHEN 0 THEN 'CITY GENERAL HOSPITAL' WHEN 1 THEN 'Sunrise Clinic of Pune' WHEN 3 THEN 'clinic' END AS hospital_name, CASE bill_id % 6 WHEN 0 THEN 'General (AC)' WHEN 1 THEN 'Private' END AS ward_type,
  CASE bill_id % 6 WHEN 0 THEN 'Dr A' || bill_id WHEN 1 THEN 'Dr B' WHEN 3 THEN 'Dr Of The Next Line' END AS consultant, CASE bill_id % 6 WHEN 0 THEN 'Star ' || bill_id WHEN 2 THEN 'Plan ' || bill_id END AS insurance FROM bills""",
    "claim_letter_layouts": BRIDGE
    + "SELECT bill_id AS doc_id, CASE WHEN bill_id % 5 IN (0, 2, 3) THEN 'C/' || bill_id END AS claim_number, CASE bill_id % 5 WHEN 0 THEN 'anna bee' WHEN 1 THEN 'Cy Dee' WHEN 2 THEN 'Eve Fox' WHEN 3 THEN 'Ida Jay' END AS policy_holder FROM bills",
}

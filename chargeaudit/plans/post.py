"""Queries of validation, deduplication, summaries, scenarios and letters over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import post as P
from ..sources.bridge import BRIDGE, bills, line_items, stored_by
from .detect import SIMILAR, similarity

LAB = ("gear", "ring")
TITLES = {"procedure_overcharge": "Procedures", "drug_overcharge": "Drugs", "missing_itemization": "Itemisation"}
PRIORITIES = {"procedure_overcharge": 100, "drug_overcharge": 88, "missing_itemization": 70}


def _issues(spark, d):
    """Two detectors in order; every third line's issue carries another amount, as a misread bill would."""
    items = stored_by(line_items(spark, d), "lines", "bill_id")  # read by both detectors, the validation and the sums
    procedures = D.procedure_overcharge(similarity(items))
    drugs = D.mrp_violation(items.filter("category IN ('SMALL', 'PROMO')"))
    drugs = drugs.withColumn("billed", F.when(F.col("pos") % 3 == 0, F.col("billed") + 10.0).otherwise(F.col("billed"))).withColumn("overcharge", F.col("billed") - F.col("benchmark"))
    return P.in_order(procedures, drugs), items


ISSUES = (
    SIMILAR
    + """, raw AS (
  SELECT 0 AS stage, bill_id, pos, CASE WHEN similarity >= 0.65 THEN 'procedure_overcharge' ELSE 'missing_itemization' END AS issue_type, description, amount::DECIMAL(18,2) AS billed,
    CASE WHEN similarity >= 0.65 THEN bench_amount::DECIMAL(18,2) END AS benchmark, CASE WHEN similarity >= 0.75 THEN 'high' WHEN similarity >= 0.65 THEN 'medium' ELSE 'low' END AS confidence
  FROM s WHERE similarity < 0.65 OR amount > bench_amount * CASE WHEN similarity >= 0.75 THEN 1.5 ELSE 2.0 END
  UNION ALL
  SELECT 1, bill_id, pos, 'drug_overcharge', description, CASE WHEN pos % 3 = 0 THEN amount + 10 ELSE amount END::DECIMAL(18,2), (rate * quantity)::DECIMAL(18,2), 'high'
  FROM li WHERE category IN ('SMALL', 'PROMO') AND rate > 0 AND quantity > 0 AND amount > rate * quantity * 1.02
), iss AS (SELECT *, billed - benchmark AS overcharge FROM raw),
seen AS (SELECT DISTINCT i.bill_id, i.stage, i.pos FROM iss i JOIN li l ON l.bill_id = i.bill_id AND (contains(lower(l.description), lower(trim(i.description))) OR contains(lower(trim(i.description)), lower(l.description))) AND abs(l.amount - i.billed) < 1 WHERE i.confidence = 'high'),
val AS (
  SELECT iss.*, CASE WHEN confidence <> 'high' THEN NULL WHEN seen.bill_id IS NULL THEN 'source row not found' WHEN billed > benchmark * 3 THEN 'over three times the benchmark' END AS note
  FROM iss LEFT JOIN seen ON iss.bill_id = seen.bill_id AND iss.stage = seen.stage AND iss.pos = seen.pos
), v AS (SELECT stage, bill_id, pos, issue_type, description, billed, benchmark, overcharge, CASE WHEN note IS NOT NULL THEN 'medium' ELSE confidence END AS confidence, note FROM val),
dd AS (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY bill_id, trim(regexp_replace(lower(description), '[^a-z0-9_ ]', '', 'g')), billed
    ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, coalesce(overcharge, 0) DESC, stage, pos) = 1
), agg AS (
  SELECT bill_id, count(*) AS n_issues, sum(overcharge) FILTER (confidence = 'high') AS high, sum(overcharge) FILTER (confidence = 'medium') AS medium,
    sum(billed) FILTER (confidence IN ('low', 'medium') AND issue_type IN ('surgical_package', 'room_stay_package', 'missing_itemization')) AS open
  FROM dd GROUP BY bill_id
), paid AS (SELECT bill_id, sum(CASE WHEN flag = 'N' THEN CAST(amount * (1 - discount) AS DECIMAL(18,2)) END) AS approved, sum(amount) FILTER (flag = 'R') AS rejected FROM li GROUP BY bill_id),
an AS (
  SELECT bills.bill_id, coalesce(n_issues, 0) AS n_issues, bill_total::DOUBLE AS total_bill, approved::DOUBLE AS total_approved, rejected::DOUBLE AS total_rejected,
    (bill_total - coalesce(approved, 0))::DOUBLE AS patient_liability, coalesce(high, 0)::DOUBLE AS verified, coalesce(open, 0)::DOUBLE AS unverified,
    coalesce(high, 0)::DOUBLE AS min_recoverable, coalesce(high, 0)::DOUBLE + coalesce(medium, 0)::DOUBLE * 0.6::DOUBLE AS max_recoverable
  FROM bills LEFT JOIN agg USING (bill_id) LEFT JOIN paid USING (bill_id)
), hc AS (SELECT bill_id, bool_or(confidence = 'high') AS h, bool_or(issue_type IN ('rejection_invalid', 'rejection_delayed', 'policy_violation')) AS c FROM dd GROUP BY bill_id),
sc AS (
  SELECT an.*, CASE WHEN NOT ins AND NOT strong THEN 'A_cash_clarification' WHEN NOT ins AND strong THEN 'B_cash_objection' WHEN ins AND claim THEN 'C_insurance_dispute' WHEN ins AND strong THEN 'D_hospital_overcharge_only' ELSE 'A_cash_clarification' END AS scenario
  FROM (SELECT an.*, an.bill_id % 3 = 0 OR coalesce(total_approved, 0) > 0 OR coalesce(total_rejected, 0) > 0 AS ins, verified > 0 OR coalesce(h, false) AS strong, coalesce(c, false) OR coalesce(total_rejected, 0) > 0 AS claim FROM an LEFT JOIN hc USING (bill_id)) an
)
"""
)
ROW = "stage, bill_id, pos, issue_type, description, billed::DOUBLE AS billed, benchmark::DOUBLE AS benchmark, overcharge::DOUBLE AS overcharge, confidence, note"


def _cents(df):
    """Differences of doubles as the exact cents that they stand for."""
    return df.withColumn("overcharge", F.col("overcharge").cast("decimal(18,2)").cast("double"))


def source_validation(spark, d):
    issues, items = _issues(spark, d)
    return _cents(P.validated(issues, items))


def issue_dedup(spark, d):
    issues, items = _issues(spark, d)
    return _cents(P.deduplicated(P.validated(issues, items)))


def _final(spark, d):
    issues, items = _issues(spark, d)
    return stored_by(P.deduplicated(P.validated(issues, items)), "issues", "bill_id"), items  # read by each part of a summary or letter


def lab_grouping(spark, d):
    final, _ = _final(spark, d)
    return P.lab_groups(final, LAB)


def _analysed(spark, d):
    final, items = _final(spark, d)
    settled = F.when(F.col("flag") == "N", (F.col("amount") * (1 - F.col("discount"))).cast("decimal(18,2)"))
    paid = items.groupBy("bill_id").agg(F.sum(settled).alias("approved"), F.sum(F.when(F.col("flag") == "R", F.col("amount"))).alias("rejected"))
    return P.analysis(bills(spark, d).join(paid, "bill_id", "left"), final, F.col("approved"), F.col("rejected")), final


def analysis_result(spark, d):
    return _analysed(spark, d)[0]


def overcharge_summary(spark, d):
    """Per bill: confirmed overcharge, unverified charges, recoverable range and number of issues."""
    return _analysed(spark, d)[0].select("bill_id", "n_issues", "verified", "unverified", "min_recoverable", "max_recoverable")


def recovery_pct(spark, d):
    a = _analysed(spark, d)[0]
    return a.select("bill_id", P.recovery_percent(F.col("max_recoverable"), F.col("verified")).alias("percent"))


def _scenario(spark, d):
    analysed, final = _analysed(spark, d)
    return P.scenario(analysed, final, F.col("bill_id") % 3 == 0), final


def scenario(spark, d):
    return _scenario(spark, d)[0].select("bill_id", "scenario")


def letter_matrix(spark, d):
    return P.letters_for(_scenario(spark, d)[0])


def topn_issues(spark, d):
    final, _ = _final(spark, d)
    return P.top_issues(final, 3).select("bill_id", "place", "pos", "issue_type", F.col("overcharge").cast("decimal(18,2)").cast("double").alias("overcharge"))


def letters(spark, d):
    analysed, final = _analysed(spark, d)
    return P.hospital_letter(analysed, final)


def letter_sections(spark, d):
    final, _ = _final(spark, d)
    return P.issue_types(final, TITLES, PRIORITIES)


def letter_validation(spark, d):
    s, final = _scenario(spark, d)
    text = P.hospital_letter(s, final, "firm")
    mark = F.when(F.col("bill_id") % 5 == 0, F.concat("content", F.lit("\n[Hospital Name]"))).when(F.col("bill_id") % 7 == 0, F.concat("content", F.lit(" n500 due"))).when(F.col("bill_id") % 11 == 0, F.concat("content", F.lit(" Demand refund."))).otherwise(F.col("content"))
    j = s.join(text.select("bill_id", mark.alias("content")), "bill_id")
    return j.select("bill_id", F.coalesce(P.letter_problem(F.col("content"), F.col("scenario"), F.col("verified")), F.lit("OK")).alias("reason"))


PART = "string_agg(i || '. ' || description || ': billed ₹' || printf('%,.2f', billed::DOUBLE) || coalesce(', reference ₹' || printf('%,.2f', benchmark::DOUBLE), ''), chr(10) ORDER BY i) FILTER (i <= 10) || CASE WHEN max(i) > 10 THEN chr(10) || 'and ' || (max(i) - 10) || ' more' ELSE '' END"
LETTER = (
    f""", ln AS (SELECT *, confidence = 'high' AS sure, row_number() OVER (PARTITION BY bill_id, confidence = 'high' ORDER BY stage, pos, description) AS i FROM dd),
pt AS (SELECT bill_id, sure, {PART.replace("'%,.2f'", "'{{:,.2f}}'").replace("printf", "format").replace("{{", "{").replace("}}", "}")} AS t, coalesce(sum(overcharge), 0) AS o, sum(billed) AS b FROM ln GROUP BY bill_id, sure),
lt AS (
  SELECT an.bill_id, 'Subject: Review of bill ' || an.bill_id || chr(10) || chr(10) || '%s' || chr(10) || 'Total billed: ₹' || format('{{:,.2f}}', total_bill)
    || coalesce(chr(10) || chr(10) || 'A. Charges above reference' || chr(10) || a.t || chr(10) || 'Subtotal: ₹' || format('{{:,.2f}}', a.o::DOUBLE), '')
    || coalesce(chr(10) || chr(10) || 'B. Charges to verify' || chr(10) || b.t || chr(10) || 'Subtotal: ₹' || format('{{:,.2f}}', b.b::DOUBLE), '')
    || chr(10) || chr(10) || 'Please answer within 15 days with the itemised records.' AS content
  FROM an LEFT JOIN pt a ON a.bill_id = an.bill_id AND a.sure LEFT JOIN pt b ON b.bill_id = an.bill_id AND NOT b.sure
)
"""
)

QUERIES = {f.__name__: f for f in (source_validation, issue_dedup, lab_grouping, analysis_result, overcharge_summary, recovery_pct, scenario, letter_matrix, topn_issues, letters, letter_sections, letter_validation)}
ORACLE_SQL = {
    "source_validation": ISSUES + f"SELECT {ROW} FROM v",
    "issue_dedup": ISSUES + f"SELECT {ROW} FROM dd",
    "lab_grouping": ISSUES
    + """, m AS (SELECT *, contains(description, 'gear') OR contains(description, 'ring') AS lab FROM dd), n AS (SELECT *, count(*) FILTER (lab) OVER (PARTITION BY bill_id) AS n FROM m)
SELECT bill_id, issue_type, description, billed::DOUBLE AS billed, benchmark::DOUBLE AS benchmark, confidence, 1 AS n_items FROM n WHERE NOT lab OR n <= 2
UNION ALL SELECT bill_id, 'missing_itemization', 'Laboratory tests — ' || count(*) || ' items for verification', sum(billed)::DOUBLE, CASE WHEN sum(benchmark) > 0 THEN sum(benchmark)::DOUBLE END, CASE WHEN coalesce(sum(benchmark), 0) > 0 THEN 'medium' ELSE 'low' END, count(*) FROM n WHERE lab AND n > 2 GROUP BY bill_id""",
    "analysis_result": ISSUES + "SELECT * FROM an",
    "overcharge_summary": ISSUES + "SELECT bill_id, n_issues, verified, unverified, min_recoverable, max_recoverable FROM an",
    "recovery_pct": ISSUES + "SELECT bill_id, CASE WHEN verified > 0 THEN round(max_recoverable / verified * 100) END AS percent FROM an",
    "scenario": ISSUES + "SELECT bill_id, scenario FROM sc",
    "letter_matrix": ISSUES
    + """, mx(scenario, letter_no, letter_type) AS (VALUES ('A_cash_clarification', 0, 'hospital_clarification'), ('A_cash_clarification', 1, 'patient_summary'), ('B_cash_objection', 0, 'hospital_professional'), ('B_cash_objection', 1, 'patient_summary'),
  ('C_insurance_dispute', 0, 'hospital_professional'), ('C_insurance_dispute', 1, 'insurer'), ('C_insurance_dispute', 2, 'patient_summary'), ('D_hospital_overcharge_only', 0, 'hospital_professional'), ('D_hospital_overcharge_only', 1, 'patient_summary'))
SELECT bill_id, scenario, letter_no, letter_type FROM sc JOIN mx USING (scenario)""",
    "topn_issues": ISSUES + "SELECT bill_id, row_number() OVER w AS place, pos, issue_type, overcharge::DOUBLE AS overcharge FROM dd WINDOW w AS (PARTITION BY bill_id ORDER BY coalesce(overcharge, 0) DESC, stage, pos) QUALIFY row_number() OVER w <= 3",
    "letters": ISSUES + LETTER.replace("%s", P.INTRO["professional"]).replace("{{", "{").replace("}}", "}") + "SELECT bill_id, content FROM lt",
    "letter_sections": ISSUES
    + "SELECT bill_id, CASE issue_type WHEN 'procedure_overcharge' THEN 'Procedures' WHEN 'drug_overcharge' THEN 'Drugs' ELSE 'Itemisation' END AS title, CASE issue_type WHEN 'procedure_overcharge' THEN 100 WHEN 'drug_overcharge' THEN 88 ELSE 70 END AS priority, count(*) AS n, sum(overcharge)::DOUBLE AS total FROM dd GROUP BY bill_id, issue_type",
    "letter_validation": ISSUES
    + "SELECT bill_id, CASE WHEN bill_id % 5 = 0 THEN 'placeholder: [Hospital Name]' WHEN bill_id % 7 = 0 THEN 'currency artifact' WHEN bill_id % 11 = 0 AND scenario = 'A_cash_clarification' THEN 'confrontational: demand refund' ELSE 'OK' END AS reason FROM sc",
}

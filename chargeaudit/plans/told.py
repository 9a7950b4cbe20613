"""Queries of what is told in words: letters that carry evidence, and summaries with recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import sanitised
from ..operators import post as P
from ..sources.bridge import BRIDGE, bills, line_items


def evidence_letters(spark, d):
    """Letters to insurers about rejected lines, each with the first two lines of evidence that say something; some have none."""
    rejected = line_items(spark, d).filter("flag = 'R'")
    lines = F.array(F.concat(F.lit("Clause: "), "category"), F.when(F.col("code") % 3 == 0, " ").otherwise(F.concat(F.lit("Quantity: "), F.col("quantity").cast("int"))), F.concat(F.lit("Code: "), "code"))
    evidence = F.when(F.col("code") % 7 != 0, F.when(F.col("code") % 5 == 0, F.slice(lines, 1, 1)).otherwise(lines))
    issues = rejected.select("bill_id", "pos", F.lit("rejection_invalid").alias("issue_type"), "description", F.col("amount").alias("billed"), F.lit(None).cast("decimal(18,2)").alias("benchmark"), F.col("amount").alias("overcharge"), F.lit("medium").alias("confidence"), F.lit(0).alias("stage"), evidence.alias("evidence"))
    per = rejected.groupBy("bill_id").agg(F.sum("amount").cast("double").alias("total_rejected"))
    analysed = bills(spark, d).join(per.hint("merge"), "bill_id", "left").select("bill_id", F.col("bill_total").cast("double").alias("total_bill"), F.lit(0.0).alias("total_approved"), F.coalesce("total_rejected", F.lit(0.0)).alias("total_rejected"))
    return P.insurer_letter(analysed, issues)


def result_text(spark, d):
    """Summary, recommendations and the cleaned number of every bill."""
    turn = F.col("code") % 6
    kind = F.when(turn == 0, "surgical_package").when(turn == 1, "missing_itemization").when(turn == 2, "procedure_overcharge").when(turn == 3, "drug_overcharge")
    level = F.when(turn == 2, "high").when(turn == 3, "medium").otherwise("low")
    items = line_items(spark, d)
    issues = items.select("bill_id", kind.alias("issue_type"), level.alias("confidence"), F.when(F.col("code") % 4 != 0, F.col("amount") - F.col("rate")).alias("overcharge")).filter("issue_type IS NOT NULL")
    days = items.groupBy("bill_id").agg(F.max("service_date").alias("_last"))
    b = bills(spark, d).join(days.hint("merge"), "bill_id", "left").select("bill_id", F.date_diff("_last", "bill_date").alias("days"))
    number = F.when(F.col("bill_id") % 4 == 0, " N/A ").when(F.col("bill_id") % 4 == 1, F.concat(F.lit("["), "bill_id", F.lit("]"))).otherwise(F.concat(F.lit(" B-"), "bill_id"))
    return P.result_text(b, issues).select("bill_id", "summary", F.array_join("recommendations", " | ").alias("recommendations"), sanitised(number).alias("bill_number"))


_RS = "'₹' || format('{{:,.{}f}}', {}::DOUBLE)"
QUERIES = {f.__name__: f for f in (evidence_letters, result_text)}
ORACLE_SQL = {
    "evidence_letters": BRIDGE
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY pos) AS i, list_filter(CASE WHEN code % 7 = 0 THEN [] WHEN code % 5 = 0 THEN ['Clause: ' || category] ELSE ['Clause: ' || category, CASE WHEN code % 3 = 0 THEN ' ' ELSE 'Quantity: ' || quantity::INT END, 'Code: ' || code] END, lambda e: trim(e) <> '')[1:2] AS e FROM li WHERE flag = 'R'),
s AS (SELECT bill_id, string_agg(i || '. ' || description || ': billed ' || {_RS.format(2, 'amount')} || array_to_string(list_transform(e, lambda x: chr(10) || '   - ' || x), ''), chr(10) ORDER BY i) FILTER (i <= 50) AS t, sum(amount) AS z FROM r GROUP BY bill_id)
SELECT bill_id, 'Grievance about the claim for bill ' || bill_id || chr(10) || 'Claimed: ' || {_RS.format(0, 'bill_total')} || chr(10) || 'Approved: ₹0' || chr(10) || 'Rejected: ' || {_RS.format(0, 'z')} || chr(10) || chr(10) || 'Decisions to review:' || chr(10) || t || chr(10) || chr(10) || 'Please give the clause and basis of each deduction within 15 working days.' AS content
FROM s JOIN bills USING (bill_id)""",
    "result_text": BRIDGE
    + f""", p AS (SELECT bill_id, count(*) FILTER (code % 6 = 2) AS h, coalesce(sum(amount - rate) FILTER (code % 6 = 2 AND code % 4 <> 0), 0) AS o, count(*) FILTER (code % 6 = 0) AS k, count(*) FILTER (code % 6 = 1) AS n, max(service_date) AS last FROM li GROUP BY bill_id),
w AS (SELECT bill_id, h, k, n, date_diff('day', bill_date, last) AS days, h || ' confirmed overcharge(s) totalling ' || {_RS.format(0, 'coalesce(o, 0)')} AS t FROM bills LEFT JOIN p USING (bill_id)),
x AS (SELECT *, concat_ws('; ', CASE WHEN h > 0 THEN t END, CASE WHEN k > 0 THEN k || ' package(s) whose procedure is to be verified' END, CASE WHEN n > 0 THEN n || ' item(s) to be clarified' END) AS f,
  concat_ws(' | ', CASE WHEN k > 0 THEN 'Before paying, ask for the exact procedure and its package rate.' END, CASE WHEN h > 0 THEN 'Challenge ' || t || ' with the reference prices.' END, CASE WHEN n > 0 THEN 'Ask for an itemised breakdown of charges without a benchmark.' END, CASE WHEN days > 15 THEN 'Escalate the delayed settlement to the regulator.' END) AS a FROM w)
SELECT bill_id, CASE WHEN f <> '' THEN 'Found: ' || f || '.' ELSE 'No issues found; the bill agrees with the benchmarks at hand.' END AS summary, CASE WHEN a <> '' THEN a ELSE 'Nothing needs to be done now.' END AS recommendations,
  CASE WHEN bill_id % 4 IN (2, 3) THEN 'B-' || bill_id END AS bill_number FROM x""",
}

"""Queries of the extraction jobs over page texts built from the order tables, and of the remaining letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions.predicates import any_keyword
from ..operators import detect as D
from ..operators import post as P
from ..sources.bridge import BRIDGE, bills, line_items, table
from .detect import CLAIMS, claims
from .post import ISSUES, LETTER, _analysed, _final, _scenario

TERMS = {"red": ["crimson", "scarlet"], "large rod": ["long bar"], "rod": ["bar"], "hot ring": ["warm loop", "bar"], "plate": ["dish"]}
DELAY = ("delay", "pending", "waiting", "processing time", "that the the")


def _bill_pages(spark, d):
    items = line_items(spark, d)
    line = F.format_string("%s %s %d %s %s", F.date_format("service_date", "dd/MM/yyyy"), F.concat(F.lit("Part "), "description"), F.col("quantity").cast("int"), F.format_number("rate", 2), F.format_number("amount", 2))
    per = items.groupBy("bill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"), F.sum("amount").alias("s"))
    b = bills(spark, d).join(per, "bill_id")
    text = F.format_string("CITY GENERAL HOSPITAL\nBill No: B-%s\nBill Date: %s\nPatient ID: P%s Age/Sex: %d Years / %s\n%s\nSubtotal: Rs. %s\nGST 5%%: 0.00\nGrand Total: Rs. %s",
        F.col("bill_id").cast("string"), F.date_format("bill_date", "dd/MM/yyyy"), F.col("patient_id").cast("string"), (F.col("patient_id") % 90).cast("int"), F.when(F.col("patient_id") % 2 == 0, "M").otherwise("Female"), "lines", F.format_number("s", 2), F.format_number("bill_total", 2))
    return b.select(F.col("bill_id").alias("doc_id"), text.alias("text"))


def extract_bills(spark, d):
    out = E.bills(_bill_pages(spark, d))
    return out.select("doc_id", "hospital_name", "bill_number", "bill_date", "patient_id", "age", "sex", "subtotal", "grand_total")


def extract_items(spark, d):
    out = E.bill_items(_bill_pages(spark, d))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"), F.min("description").alias("first_description"))


def extract_claims(spark, d):
    c = claims(spark, d)
    text = F.format_string("Claim Number: C/%s\nPolicy Number: P-%s\nSum Insured: Rs. %s\nCashless: %s\nDischarge Date: %s\nDate of Rejection: %s\nTotal Amount Claimed: Rs. %s\nSettlement Mode: NEFT  \n",
        F.col("bill_id").cast("string"), F.col("patient_id").cast("string"), F.format_number(F.col("bill_total").cast("int"), 0), F.when(F.col("bill_id") % 2 == 0, "Yes").otherwise("no"),
        F.date_format("discharge_date", "dd/MM/yyyy"), F.when(F.col("bill_id") % 3 == 0, F.date_format("decision_date", "dd-MM-yyyy")).otherwise(F.date_format("decision_date", "dd/MM/yyyy")), F.format_number(F.col("bill_total").cast("int"), 0))
    out = E.claims(c.select(F.col("bill_id").alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "claim_number", "policy_number", "sum_insured", "cashless", "amount_claimed", "amount_settled", "settlement_mode", F.col("days").cast("double").alias("days"), F.col("late").cast("string").alias("late"))


def extract_discharges(spark, d):
    i = line_items(spark, d).filter("line_status = 'F'")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x, n: F.concat((n + 1).cast("string"), F.lit(". "), x["description"]))
    per = i.groupBy("bill_id").agg(F.array_join(names, "\n").alias("procedures"), F.count("*").cast("int").alias("n"))
    text = F.format_string("Length of Stay: %d days\nWards: ICU (%dd), Private Deluxe (4 days)\nProcedures\n%s\n", "n", "n", "procedures")
    out = E.discharges(per.select(F.col("bill_id").alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "stay_days", F.array_join(F.transform("wards", lambda w: F.concat_ws(":", w["type"], w["days"].cast("string"))), ",").alias("wards"), F.array_join("procedures", "|").alias("procedures"))


def abbreviation_expand(spark, d):
    terms = table(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit(" (new) 12")).otherwise(F.lit(""))).alias("term"))
    return E.expanded(terms, TERMS)


def anchor_span(spark, d):
    i = line_items(spark, d)
    return E.anchored(i, F.col("flag") == "N", "bill_id", "pos", "category", "description", ["LARGE", "SMALL", "PROMO"])


def delay_language(spark, d):
    """The first turn of each conversation that speaks of delay."""
    c = table(spark, d, "conversations").filter(any_keyword(F.col("text"), DELAY))
    return D.keep_first(c, ["conv_id"], ["turn"]).select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


def _part(spark, d, categories, unverified):
    final, items = _final(spark, d)
    keep = final.join(items.filter(F.col("category").isin(*categories)).select("bill_id", "pos"), ["bill_id", "pos"], "left_semi")
    return P.analysis(bills(spark, d), keep, F.lit(0.0), F.lit(0.0), unverified).select("bill_id", "n_issues", "verified", "unverified", "max_recoverable")


def analysis_pharmacy(spark, d):
    return _part(spark, d, ("SMALL", "PROMO"), F.col("confidence").isin("low", "medium"))


def analysis_lab(spark, d):
    return _part(spark, d, ("LARGE", "MEDIUM"), F.col("confidence") == "low")


def clarification_letters(spark, d):
    analysed, final = _analysed(spark, d)
    return P.clarification_letter(analysed, final)


def patient_summaries(spark, d):
    analysed, final = _analysed(spark, d)
    return P.patient_summary(analysed, final)


def insurer_letters(spark, d):
    analysed, final = _analysed(spark, d)
    return P.insurer_letter(analysed, final)


def letter_run(spark, d):
    s, final = _scenario(spark, d)
    return P.letter_run(s, final).groupBy("letter_type", "scenario").agg(F.count("*").alias("n_letters"), F.count("reason").alias("n_skipped"))


PART_SQL = """, part_of AS (SELECT dd.* FROM dd JOIN li USING (bill_id, pos) WHERE category IN ({c})), ag AS (
  SELECT bill_id, count(*) AS n, sum(overcharge) FILTER (confidence = 'high') AS h, sum(overcharge) FILTER (confidence = 'medium') AS m, sum(billed) FILTER (confidence IN ({u})) AS o FROM part_of GROUP BY bill_id)
SELECT bill_id, coalesce(n, 0) AS n_issues, coalesce(h, 0)::DOUBLE AS verified, coalesce(o, 0)::DOUBLE AS unverified, coalesce(h, 0)::DOUBLE + coalesce(m, 0)::DOUBLE * 0.6::DOUBLE AS max_recoverable FROM bills LEFT JOIN ag USING (bill_id)"""

QUERIES = {f.__name__: f for f in (extract_bills, extract_items, extract_claims, extract_discharges, abbreviation_expand, anchor_span, delay_language, analysis_pharmacy, analysis_lab, clarification_letters, patient_summaries, insurer_letters, letter_run)}
_RS = "'₹' || format('{{:,.{n}f}}', {x}::DOUBLE)"


def _rupees(x: str, n: int = 2) -> str:
    return _RS.format(x=x, n=n)


def _section(name: str, where: str, limit: int) -> str:
    """CTE of the numbered lines of each bill's issues, as letters list them."""
    line = "i || '. ' || description || ': billed ' || " + _rupees("billed") + " || coalesce(', reference ' || " + _rupees("benchmark") + ", '')"
    return f""", {name}_n AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY stage, pos, description) AS i FROM dd WHERE {where}),
{name} AS (SELECT bill_id, string_agg({line}, chr(10) ORDER BY i) FILTER (i <= {limit}) || CASE WHEN max(i) > {limit} THEN chr(10) || 'and ' || (max(i) - {limit}) || ' more' ELSE '' END AS t FROM {name}_n GROUP BY bill_id)"""


NL = " || chr(10) || "
CLARIFICATION = (
    _section("open_", "confidence IN ('low', 'medium')", 50)
    + ", cl AS (SELECT an.bill_id, 'Request for clarification of bill ' || an.bill_id" + NL + "'Total: ' || " + _rupees("total_bill", 0)
    + " || coalesce(chr(10)" + NL + "'Charges to clarify:'" + NL + "open_.t || chr(10)" + NL + "'For each please give the exact name and code, whether it is a package, and your published tariff.', '') || chr(10)" + NL + "'Please answer in writing within 14 days.' AS content FROM an LEFT JOIN open_ USING (bill_id))"
)
SUMMARY = (
    "".join(_section(f"{c}_", f"confidence = '{c}'", 10) for c in ("high", "medium", "low"))
    + ", ps AS (SELECT an.bill_id, 'Summary of bill ' || an.bill_id" + NL + "'Total: ' || " + _rupees("total_bill", 0) + NL + "'Confirmed excess: ' || " + _rupees("verified", 0)
    + "".join(f" || coalesce(chr(10)" + NL + f"'{title}:'" + NL + f"{c}_.t, '')" for c, title in (("high", "Confirmed excess"), ("medium", "To verify"), ("low", "To clarify")))
    + " || chr(10)" + NL + "'Keep the bill, the receipts and proof of every letter.' AS content FROM an LEFT JOIN high_ USING (bill_id) LEFT JOIN medium_ USING (bill_id) LEFT JOIN low_ USING (bill_id))"
)
INSURER = (
    _section("claim_", "issue_type IN ('rejection_invalid', 'rejection_delayed', 'policy_violation')", 50)
    + ", il AS (SELECT an.bill_id, 'Grievance about the claim for bill ' || an.bill_id" + NL + "'Claimed: ' || " + _rupees("total_bill", 0) + NL + "'Approved: ' || " + _rupees("coalesce(total_approved, 0)", 0) + NL + "'Rejected: ' || " + _rupees("coalesce(total_rejected, 0)", 0)
    + " || coalesce(chr(10)" + NL + "'Decisions to review:'" + NL + "claim_.t, '') || chr(10)" + NL + "'Please give the clause and basis of each deduction within 15 working days.' AS content FROM an LEFT JOIN claim_ USING (bill_id) WHERE claim_.t IS NOT NULL OR total_rejected > 0)"
)
RUN = (
    LETTER.replace("%s", P.INTRO["professional"]).replace("{{", "{").replace("}}", "}") + CLARIFICATION + SUMMARY + INSURER
    + """, mx(scenario, letter_type) AS (VALUES ('A_cash_clarification', 'hospital_clarification'), ('A_cash_clarification', 'patient_summary'), ('B_cash_objection', 'hospital_professional'), ('B_cash_objection', 'patient_summary'),
  ('C_insurance_dispute', 'hospital_professional'), ('C_insurance_dispute', 'insurer'), ('C_insurance_dispute', 'patient_summary'), ('D_hospital_overcharge_only', 'hospital_professional'), ('D_hospital_overcharge_only', 'patient_summary')),
every AS (SELECT bill_id, 'hospital_professional' AS letter_type, content FROM lt UNION ALL SELECT bill_id, 'hospital_clarification', content FROM cl UNION ALL SELECT bill_id, 'insurer', content FROM il UNION ALL SELECT bill_id, 'patient_summary', content FROM ps)
SELECT letter_type, scenario, count(*) AS n_letters, count(*) FILTER (length(trim(content)) < 100) AS n_skipped FROM sc JOIN mx USING (scenario) JOIN every USING (bill_id, letter_type) GROUP BY ALL"""
)
ORACLE_SQL = {
    "abbreviation_expand": """WITH t AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (new) 12' ELSE '' END AS term, p_name AS clean FROM part),
w AS (SELECT term, CASE clean WHEN 'large rod' THEN ['long bar'] WHEN 'hot ring' THEN ['warm loop', 'bar'] ELSE
  list_concat(list_concat(CASE WHEN regexp_matches(clean, '\\bplate\\b') THEN ['dish'] ELSE [] END, CASE WHEN regexp_matches(clean, '\\bred\\b') THEN ['crimson', 'scarlet'] ELSE [] END), CASE WHEN regexp_matches(clean, '\\brod\\b') THEN ['bar'] ELSE [] END) END AS x FROM t)
SELECT term, trim(term || ' ' || array_to_string(x, ' ')) AS expanded FROM w""",
    "clarification_letters": ISSUES + CLARIFICATION + " SELECT bill_id, content FROM cl",
    "patient_summaries": ISSUES + SUMMARY + " SELECT bill_id, content FROM ps",
    "insurer_letters": ISSUES + INSURER + " SELECT bill_id, content FROM il",
    "letter_run": ISSUES + RUN,
    "extract_bills": BRIDGE
    + "SELECT bill_id AS doc_id, 'CITY GENERAL HOSPITAL' AS hospital_name, 'B-' || bill_id AS bill_number, strftime(bill_date, '%d/%m/%Y') AS bill_date, 'P' || patient_id AS patient_id, (patient_id % 90)::INTEGER AS age, CASE WHEN patient_id % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, sum(amount)::DOUBLE AS subtotal, bill_total::DOUBLE AS grand_total FROM bills JOIN li USING (bill_id) GROUP BY ALL",
    "extract_items": BRIDGE + "SELECT bill_id AS doc_id, count(*) AS n_items, sum(amount)::DOUBLE AS amount, min('Part ' || description) AS first_description FROM li JOIN bills USING (bill_id) GROUP BY bill_id",
    "extract_claims": CLAIMS
    + "SELECT bill_id AS doc_id, 'C/' || bill_id AS claim_number, 'P-' || patient_id AS policy_number, trunc(bill_total)::BIGINT AS sum_insured, bill_id % 2 = 0 AS cashless, trunc(bill_total)::DOUBLE AS amount_claimed, NULL::DOUBLE AS amount_settled, 'NEFT' AS settlement_mode, CASE WHEN bill_id % 3 <> 0 THEN (decision_date - discharge_date)::DOUBLE END AS days, CASE WHEN bill_id % 3 <> 0 THEN (decision_date - discharge_date > 15)::VARCHAR END AS late FROM claims JOIN bills USING (bill_id)",
    "extract_discharges": BRIDGE
    + "SELECT bill_id AS doc_id, count(*)::INTEGER AS stay_days, 'ICU:' || count(*) || ',Private Deluxe:4' AS wards, string_agg(description, '|' ORDER BY pos) AS procedures FROM li WHERE line_status = 'F' GROUP BY bill_id",
    "anchor_span": BRIDGE
    + ", r AS (SELECT *, sum((flag = 'N')::INT) OVER (PARTITION BY bill_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS entry FROM li) SELECT bill_id, entry::BIGINT AS entry, string_agg(description, ' ' ORDER BY pos) FILTER (category = 'LARGE') AS \"LARGE\", string_agg(description, ' ' ORDER BY pos) FILTER (category = 'SMALL') AS \"SMALL\", string_agg(description, ' ' ORDER BY pos) FILTER (category = 'PROMO') AS \"PROMO\" FROM r WHERE entry > 0 GROUP BY bill_id, entry",
    "delay_language": "SELECT conv_id, turn, length(text)::BIGINT AS chars FROM conversations WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in DELAY) + " QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "analysis_pharmacy": ISSUES + PART_SQL.format(c="'SMALL', 'PROMO'", u="'low', 'medium'"),
    "analysis_lab": ISSUES + PART_SQL.format(c="'LARGE', 'MEDIUM'", u="'low'"),
}

"""Queries of page fields, matching and evidence over texts and lines built from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import rules
from ..functions.predicates import any_keyword
from ..functions.text import terms
from ..operators import detect as D
from ..operators import matching as M
from ..operators import pages as G
from ..sources.bridge import BRIDGE, benchmarks, bills, line_items
from .detect import CLAIMS, claims

SYNONYMS = {"widget": "small bolt", "anvil": "old hot rod", "red": "crimson"}
REGULATIONS = ("Claims are to be settled within thirty days of discharge", "Delay in claims settlement bears interest", "Room rent is capped by the policy", "Grievances are answered in fourteen days")
QUESTION = "delay in claims settlement after discharge"
LABELS = {"SMALL": "Surgical package", "LARGE": "Room stay", "PROMO": "Single items"}


def _letters(spark, d):
    """Claim letters with every field that the extraction knows."""
    b = bills(spark, d)
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    head = F.when(F.col("bill_id") % 3 == 0, "Claims department").otherwise(F.concat(F.lit("NATION "), F.col("patient_id").cast("string"), F.lit(" HEALTH INSURANCE LTD")))
    text = F.concat(
        head, F.lit("\nIRDAI Registration No: "), F.col("patient_id").cast("string"), F.lit("\nClaim Number: C/"), F.col("bill_id").cast("string"), F.lit("\nPolicy Holder: Anna Bee\nInsured Name: Cy Dee  \nHospital: City Care "), F.col("department"),
        F.lit("\nAdmission Date: "), day("bill_date"), F.lit("\nPre-Auth Date: "), day(F.date_add("bill_date", 1)), F.lit("\nPre-Auth Status: Approved in part  x\nDate of Letter: "), day(F.date_add("bill_date", 9)),
        F.lit("\nGrievance Officer: Ms. Eve Fox  Email: eve"), F.col("patient_id").cast("string"), F.lit("@corp.example.org\nPhone: +91 22-"), F.col("patient_id").cast("string"), F.lit("  \n"),
    )
    return b.select(F.col("bill_id").alias("doc_id"), text.alias("text"))


def extract_claim_letters(spark, d):
    t = F.col("text")
    out = _letters(spark, d).select("doc_id", *X.fields(t, X.CLAIM_FIELDS), X.insurer(t).alias("insurer"), X.field(t, X.REGISTRATION).alias("registration"), *X.fields(t, X.CONTACT_FIELDS))
    return out.select("doc_id", "claim_number", "policy_holder", "insured_name", "hospital", "admission_date", "pre_auth_date", "pre_auth_status", "date_of_letter", "insurer", "registration", "officer_name", "officer_email", "officer_phone")


def _summaries(spark, d):
    """Discharge summaries of finished lines."""
    i = line_items(spark, d).filter("line_status = 'F' AND pos <= 3")
    per = i.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("pos", "description", "service_date", "code"))).alias("x"))
    first = F.get("x", 0)
    day = F.date_format(first["service_date"], "dd/MM/yyyy")
    procedures = F.array_join(F.transform("x", lambda x, n: F.concat((n + 1).cast("string"), F.lit(". "), x["description"], F.lit("\nDate: "), F.date_format(x["service_date"], "dd/MM/yyyy"), F.lit(" | Performed by: Dr Gil Hay\nNo trouble seen.\n"))), "")
    drugs = F.array_join(F.transform("x", lambda x, n: F.concat((n + 1).cast("string"), F.lit(". Tab. Aspirin "), F.pmod(x["code"], F.lit(90)).cast("string"), F.lit("mg Once daily, "), F.when(x["code"] % 2 == 0, "Lifelong").otherwise("after food"))), "\n")
    text = F.concat(
        F.lit("Patient Name: Ida Jay  Age / Sex: "), F.pmod("bill_id", F.lit(90)).cast("string"), F.lit(" Years / F\nMRN / Patient ID: MR-"), F.col("bill_id").cast("string"), F.lit("\nBill Number: B-"), F.col("bill_id").cast("string"), F.lit("\nAdmission Date: "), day,
        F.lit("\nConsultant: Dr Kim Lee\nAttending Surgeon: Dr Gil Hay\nFINAL DIAGNOSIS\nPrimary: Wear of the "), first["description"], F.when(F.col("bill_id") % 2 == 0, " ICD-10: M17.1").otherwise(""),
        F.lit("\nSecondary:\n• Mild pain of "), first["description"], F.lit(" (ICD-10: M25.5)\n• Late onset\nPROCEDURES PERFORMED\n"), procedures, F.lit("CLINICAL COURSE / HOSPITAL STAY\nSlow   but\nsteady.\nDISCHARGE MEDICATIONS\n"), drugs,
        F.lit("\nCONDITION AT DISCHARGE\nStable\nFOLLOW-UP INSTRUCTIONS\nCome back soon\n____"),
    )
    return per.select(F.col("bill_id").alias("doc_id"), text.alias("text"))


def extract_patients(spark, d):
    t = F.col("text")
    out = _summaries(spark, d).select("doc_id", *X.fields(t, X.PATIENT_FIELDS))
    return out.select("doc_id", "name", "mrn", "bill_number", "admission_date", "discharge_date", "consultant", "attending_surgeon", F.regexp_extract("age_sex", r"(\d+)", 1).cast("int").alias("age"))


def extract_diagnoses(spark, d):
    name, code = X.primary(F.col("text"))
    second = F.transform(X.secondary(F.col("text")), lambda x: F.concat_ws("/", x["diagnosis"], x["icd10"]))
    return _summaries(spark, d).select("doc_id", name.alias("diagnosis"), code.alias("icd10"), F.array_join(second, "|").alias("secondary"))


def extract_procedures(spark, d):
    rows = _summaries(spark, d).select("doc_id", F.posexplode(X.procedures(F.col("text"))).alias("n", "x"))
    return rows.select("doc_id", "n", "x.*")


def extract_medications(spark, d):
    rows = _summaries(spark, d).select("doc_id", F.posexplode(X.medications(F.col("text"))).alias("n", "x"))
    return rows.select("doc_id", "n", "x.*")


def extract_narratives(spark, d):
    m = X.narratives(F.col("text"))
    return _summaries(spark, d).select("doc_id", F.size(m).alias("n_sections"), m["clinical_course"].alias("course"), m["condition_at_discharge"].alias("condition"), m["follow_up"].alias("follow_up"))


def citation_mentions(spark, d):
    i = line_items(spark, d)
    text = F.concat("description", F.lit(": CGHS rate: "), F.col("code").cast("string"), F.lit(", NPPA ceiling ₹"), F.col("pos").cast("string"), F.when(F.col("code") % 3 == 0, " and IRDAI circular A-12/B").otherwise(""))
    c = X.citations(text)
    return i.select("bill_id", "pos", F.array_join(c["rates"], ",").alias("rates"), F.array_join(c["ceilings"], ",").alias("ceilings"), F.array_join(c["regulations"], ",").alias("regulations"))


def non_payable_entries(spark, d):
    """Numbered entries with their continuation lines, split into name and status."""
    i = line_items(spark, d)
    status = F.element_at(F.array(*map(F.lit, (" Not Payable", "  Essential part", " Payable as billed", "   see note", ""))), (F.col("code") % 5 + 1).cast("int"))
    lines = i.select(F.col("bill_id").alias("doc_id"), F.col("pos").alias("line"), F.when(F.col("pos") % 2 == 1, F.concat(F.col("pos").cast("string"), F.lit(" "), "description", status)).otherwise(F.concat(F.lit("of steel"), status)).alias("text"))
    r = G.records(lines, F.col("text").rlike(r"^\s*\d{1,3}\s+"), "doc_id", "line", "text")
    return r.select("doc_id", "record", X.name_and_status(F.regexp_extract("joined", r"^\s*\d{1,3}\s+(.+)$", 1)).alias("x")).select("doc_id", "record", "x.*")


def term_lists(spark, d):
    """Policy sections and at most five exclusion words that a text holds."""
    b = benchmarks(spark, d)
    text = F.concat("name", F.when(F.col("code") % 2 == 0, " Room Rent and dental, cosmetic, WAR").otherwise(""), F.when(F.col("code") % 3 == 0, " maternity, pregnancy, elective, nuclear, suicide coverage").otherwise(""))
    return b.select("code", F.array_join(terms(text, rules.POLICY_SECTIONS), ",").alias("sections"), F.array_join(F.slice(terms(text, rules.EXCLUSION_WORDS), 1, 5), ",").alias("exclusions"))


def consumable_lines(spark, d):
    i = line_items(spark, d).withColumn("description", F.concat("description", F.when(F.col("code") % 5 == 0, " Vial").when(F.col("code") % 7 == 0, " collection tube").otherwise("")))
    return i.filter(any_keyword(F.col("description"), rules.CONSUMABLES)).groupBy("description").agg(F.count("*").alias("n"))


def _coded(spark, d):
    """Lines of which some have a code; the others only their text."""
    note = F.when(F.col("code") % 4 == 1, F.concat("description", F.lit(" set"))).when(F.col("code") % 4 == 2, F.concat(F.lit("brand new "), "description")).otherwise(F.col("description"))
    return line_items(spark, d).withColumn("description", note).withColumn("code", F.when(F.col("code") % 4 == 0, F.col("code")))


def matched_lines(spark, d):
    """The benchmark of each line, by code or by text."""
    m = M.code_or_text(_coded(spark, d), benchmarks(spark, d))
    return m.select("bill_id", "pos", "matched", F.col("match_rate").cast("double").alias("match_rate"), "similarity")


def matched_overcharge(spark, d):
    """Overcharges by the ladder of the similarity that the match found."""
    m = M.code_or_text(_coded(spark, d), benchmarks(spark, d))
    return D.procedure_overcharge(m.withColumn("similarity", F.coalesce(F.col("similarity"), F.lit(0.0)).cast("decimal(5,4)")).withColumn("bench_amount", F.col("match_rate") * F.col("quantity")))


def best_of_two_texts(spark, d):
    """The better of a line's own text and its expansion."""
    i = line_items(spark, d).withColumn("expanded", F.when(F.contains("description", F.lit("ring")), F.concat("description", F.lit(" hot gear"))))
    return M.best_of_texts(i.withColumn("original", F.concat("description", F.lit(" test item"))), benchmarks(spark, d), ("expanded", "original")).select("bill_id", "pos", "source", "name", "similarity")


def synonym_match(spark, d):
    i = line_items(spark, d).withColumn("procedure_name", F.when(F.col("code") % 2 == 0, "red one"))
    return M.synonym_overcharges(i, benchmarks(spark, d), "procedure_name", SYNONYMS)


def episode_evidence(spark, d):
    out = M.episode_issues(line_items(spark, d), F.col("category"), LABELS, 2)
    return out.select("bill_id", "issue_id", "issue_type", "description", "billed", "confidence", F.array_join(F.slice("evidence", 1, 2), "; ").alias("first_two"), F.size("evidence").alias("n_evidence"))


def late_claim_citations(spark, d):
    late = D.late_settlements(claims(spark, d)).select("bill_id", "days", M.evidence(F.concat(F.lit("Settled after "), F.col("days"), F.lit(" days")), F.when(F.col("days") > 60, "Over sixty days")).alias("evidence"))
    regulations = spark.createDataFrame([(r,) for r in REGULATIONS], "name string")
    return M.with_citations(late, QUESTION, regulations).select("bill_id", F.array_join("evidence", "; ").alias("evidence"))


def flexible_fields(spark, d):
    """Issues whose fields stand under several names, and those that speak of rods or gears."""
    i = line_items(spark, d)
    raw = i.select(
        "bill_id", "pos", F.when(F.col("code") % 2 == 0, F.col("category")).otherwise("").alias("type"), F.when(F.col("code") % 3 == 0, F.lit("kind")).alias("issue_type"), F.when(F.col("code") % 2 == 1, F.lit(0.0)).otherwise(F.col("amount").cast("double")).alias("amount_inr"),
        F.col("amount").cast("double").alias("amount"), F.when(F.col("code") % 5 != 0, F.col("description")).alias("summary"), F.when(F.col("code") % 5 == 0, F.array("description", F.lit("seen"))).alias("evidence_list"),
    )
    empty = F.array().cast("array<string>")
    named = raw.select("bill_id", "pos", F.coalesce(X.first_of("type", "issue_type"), F.lit("UNKNOWN_TYPE")).alias("issue_type"), X.first_of("amount_inr", "amount").alias("amount"), F.coalesce("summary", F.lit("")).alias("description"), F.coalesce("evidence_list", empty).alias("evidence"))
    return M.keyword_issues(named, ("rod", "gear")).select("bill_id", "pos", "issue_type", "amount", "description")


def code_rows(spark, d):
    """Price rows with a proper code and enough cells, and how many are dropped; likewise for prices."""
    b = benchmarks(spark, d)
    code = F.concat(F.when(F.col("code") % 3 == 0, "ab").otherwise("AB"), F.lpad(F.pmod("code", F.lit(1000)).cast("string"), 3, "0"))
    rows = b.select("name", code.alias("code"), F.when(F.col("type") == "SMALL", F.array("name")).otherwise(F.array_repeat("name", 6)).alias("cells"), F.when(F.col("brand").endswith("1"), None).otherwise(F.col("rate")).alias("price"))
    kept, coded = M.kept_and_dropped(rows, F.col("code").rlike("^[A-Z]{2}[0-9]{3}$") & (F.size("cells") >= 6))
    _, priced = M.kept_and_dropped(kept, F.col("price").isNotNull())
    return coded.withColumn("step", F.lit("code")).unionByName(priced.withColumn("step", F.lit("price")))


def component_map(spark, d):
    """Per device its components' highest prices as a map."""
    b = benchmarks(spark, d).groupBy(F.col("type").alias("device"), F.split_part("name", F.lit(" "), F.lit(2)).alias("component")).agg(F.max("rate").alias("rate"))
    per = b.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("component", "rate"))).alias("x"))
    m = F.map_from_arrays("x.component", "x.rate")
    return per.select("device", F.size(m).alias("n"), F.array_join(F.map_keys(m), ",").alias("components"), m["gear"].cast("double").alias("gear"))


QUERIES = {
    f.__name__: f
    for f in (extract_claim_letters, extract_patients, extract_diagnoses, extract_procedures, extract_medications, extract_narratives, citation_mentions, non_payable_entries, term_lists, consumable_lines, matched_lines, matched_overcharge,
              best_of_two_texts, synonym_match, episode_evidence, late_claim_citations, flexible_fields, code_rows, component_map)
}
DAY = "strftime({}, '%d/%m/%Y')"
SUMMARY = BRIDGE + ", f AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY pos) AS n FROM li WHERE line_status = 'F' AND pos <= 3), one AS (SELECT * FROM f WHERE n = 1)"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


def near(texts: str, extra: str = "rate") -> str:
    """CTEs that rank the names of ``bench`` by common words for the rows (text) of ``texts``."""
    return f""", t0 AS (SELECT DISTINCT text, {WORDS.format('text')} AS w FROM {texts}), n0 AS (SELECT DISTINCT name, {extra}, {WORDS.format('name')} AS v FROM bench),
s0 AS (SELECT text, name, {extra}, round(len(list_intersect(w, v)) / sqrt(len(w)::DOUBLE * len(v)), 4) AS similarity FROM t0 JOIN n0 ON len(list_intersect(w, v)) > 0),
r0 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, name, {extra}) AS rank FROM s0)"""


CODED = BRIDGE + """, cl AS (SELECT * REPLACE (CASE code % 4 WHEN 1 THEN description || ' set' WHEN 2 THEN 'brand new ' || description ELSE description END AS description, CASE WHEN code % 4 = 0 THEN code END AS code) FROM li),
tx AS (SELECT DISTINCT description AS text FROM cl WHERE code IS NULL)""" + near("tx") + """,
ml AS (SELECT cl.*, coalesce(bench.name, r0.name) AS matched, coalesce(bench.rate, r0.rate) AS match_rate, CASE WHEN bench.code IS NOT NULL THEN 1.0::DOUBLE ELSE r0.similarity END AS similarity FROM cl LEFT JOIN bench ON bench.code = cl.code LEFT JOIN r0 ON r0.text = cl.description AND r0.rank = 1 AND bench.code IS NULL)"""
ORACLE_SQL = {
    "extract_claim_letters": BRIDGE
    + f"SELECT bill_id AS doc_id, 'C/' || bill_id AS claim_number, 'Anna Bee' AS policy_holder, 'Cy Dee' AS insured_name, 'City Care ' || department AS hospital, {DAY.format('bill_date')} AS admission_date, {DAY.format('bill_date + 1')} AS pre_auth_date, 'Approved in part' AS pre_auth_status, {DAY.format('bill_date + 9')} AS date_of_letter, CASE WHEN bill_id % 3 <> 0 THEN 'NATION ' || patient_id || ' HEALTH INSURANCE LTD' END AS insurer, patient_id::VARCHAR AS registration, 'Eve Fox' AS officer_name, 'eve' || patient_id || '@corp.example.org' AS officer_email, '+91 22-' || patient_id AS officer_phone FROM bills",
    "extract_patients": SUMMARY
    + f"SELECT bill_id AS doc_id, 'Ida Jay' AS name, 'MR-' || bill_id AS mrn, 'B-' || bill_id AS bill_number, {DAY.format('service_date')} AS admission_date, NULL::VARCHAR AS discharge_date, 'Dr Kim Lee' AS consultant, 'Dr Gil Hay' AS attending_surgeon, (bill_id % 90)::INTEGER AS age FROM one",
    "extract_diagnoses": SUMMARY + "SELECT bill_id AS doc_id, 'Wear of the ' || description AS diagnosis, CASE WHEN bill_id % 2 = 0 THEN 'M17.1' ELSE 'M25.5' END AS icd10, 'Mild pain of ' || description || '/M25.5|Late onset' AS secondary FROM one",
    "extract_procedures": SUMMARY + f"SELECT bill_id AS doc_id, (n - 1)::INTEGER AS n, description AS name, {DAY.format('service_date')} AS date, 'Dr Gil Hay' AS performed_by, 'No trouble seen' AS notes FROM f",
    "extract_medications": SUMMARY + "SELECT bill_id AS doc_id, (n - 1)::INTEGER AS n, 'Tab. Aspirin ' || code % 90 || 'mg' AS drug, CASE WHEN code % 2 = 0 THEN 'Once daily' ELSE 'Once daily, after food' END AS frequency, CASE WHEN code % 2 = 0 THEN 'Lifelong' END AS duration FROM f",
    "extract_narratives": SUMMARY + "SELECT bill_id AS doc_id, 3 AS n_sections, 'Slow but steady.' AS course, 'Stable' AS condition, 'Come back soon' AS follow_up FROM one",
    "citation_mentions": BRIDGE + "SELECT bill_id, pos, code::VARCHAR AS rates, pos::VARCHAR AS ceilings, CASE WHEN code % 3 = 0 THEN 'A-12/B' ELSE '' END AS regulations FROM li",
    "non_payable_entries": BRIDGE
    + """, ln AS (SELECT bill_id, pos, [' Not Payable', '  Essential part', ' Payable as billed', '   see note', ''][code % 5 + 1] AS st, description FROM li), q AS (SELECT bill_id, (pos + 1) // 2 AS record, string_agg(CASE WHEN pos % 2 = 1 THEN description ELSE 'of steel' END || st, ' ' ORDER BY pos) AS x FROM ln GROUP BY ALL),
k AS (SELECT *, list_filter([strpos(x, 'Not Payable'), strpos(x, 'Not payable'), strpos(x, 'Non Payable'), strpos(x, 'Payable'), strpos(x, 'Essential')], lambda p: p > 1)[1] AS p FROM q)
SELECT bill_id AS doc_id, record::BIGINT AS record, trim(CASE WHEN p IS NOT NULL THEN x[:p - 1] ELSE regexp_split_to_array(x, '\\s{2,}')[1] END) AS name, CASE WHEN p IS NOT NULL THEN trim(x[p:]) WHEN regexp_matches(x, '\\s{2,}') THEN trim(regexp_replace(x, '^.*?\\s{2,}', '')) ELSE '' END AS status FROM k""",
    "term_lists": BRIDGE
    + ", t AS (SELECT code, lower(name || CASE WHEN code % 2 = 0 THEN ' Room Rent and dental, cosmetic, WAR' ELSE '' END || CASE WHEN code % 3 = 0 THEN ' maternity, pregnancy, elective, nuclear, suicide coverage' ELSE '' END) AS x FROM bench) SELECT code, array_to_string(list_filter("
    + str(list(rules.POLICY_SECTIONS)) + ", lambda w: contains(x, w)), ',') AS sections, array_to_string(list_filter(" + str(list(rules.EXCLUSION_WORDS)) + ", lambda w: contains(x, w))[1:5], ',') AS exclusions FROM t",
    "consumable_lines": BRIDGE + "SELECT description || CASE WHEN code % 5 = 0 THEN ' Vial' ELSE ' collection tube' END AS description, count(*) AS n FROM li WHERE code % 5 = 0 OR code % 7 = 0 GROUP BY ALL",
    "matched_lines": CODED + " SELECT bill_id, pos, matched, match_rate::DOUBLE AS match_rate, similarity FROM ml",
    "matched_overcharge": CODED
    + """, s AS (SELECT *, coalesce(similarity, 0)::DECIMAL(5,4) AS sim, match_rate * quantity AS ba FROM ml)
SELECT bill_id, pos, CASE WHEN sim >= 0.65 THEN 'procedure_overcharge' ELSE 'missing_itemization' END AS issue_type, description, amount::DOUBLE AS billed, CASE WHEN sim >= 0.65 THEN ba::DOUBLE END AS benchmark, CASE WHEN sim >= 0.65 THEN (amount - ba)::DOUBLE END AS overcharge,
  CASE WHEN sim >= 0.75 THEN 'high' WHEN sim >= 0.65 THEN 'medium' ELSE 'low' END AS confidence FROM s WHERE sim < 0.65 OR amount > ba * CASE WHEN sim >= 0.75 THEN 1.5 ELSE 2.0 END""",
    "best_of_two_texts": BRIDGE
    + ", a AS (SELECT bill_id, pos, 0 AS source, description || ' hot gear' AS text FROM li WHERE contains(description, 'ring') UNION ALL SELECT bill_id, pos, 1, description || ' test item' FROM li)" + near("a")
    + " SELECT bill_id, pos, source, name, similarity FROM a JOIN r0 ON a.text = r0.text AND rank = 1 AND similarity >= 0.45 QUALIFY row_number() OVER (PARTITION BY bill_id, pos ORDER BY similarity DESC, source) = 1",
    "synonym_match": BRIDGE
    + ", a AS (SELECT bill_id, pos, amount, CASE WHEN contains(description, 'widget') THEN replace(description, 'widget', 'small bolt') WHEN contains(description, 'anvil') THEN replace(description, 'anvil', 'old hot rod') WHEN contains(description, 'red') OR code % 2 = 0 THEN replace(description, 'red', 'crimson') END AS text, description FROM li), b AS (SELECT * FROM a WHERE text IS NOT NULL AND text <> description)" + near("b")
    + " SELECT bill_id, pos, b.text AS expanded, name AS matched, amount::DOUBLE AS billed, rate::DOUBLE AS benchmark FROM b JOIN r0 ON b.text = r0.text AND rank = 1 WHERE amount > rate::DOUBLE * 1.5::DOUBLE",
    "episode_evidence": BRIDGE
    + """, w AS (SELECT bill_id, sum(amount) AS whole FROM li GROUP BY bill_id), o AS (SELECT *, row_number() OVER (PARTITION BY bill_id, category ORDER BY amount DESC, pos, description) AS k FROM li WHERE category IN ('SMALL', 'LARGE', 'PROMO')),
p AS (SELECT bill_id, category, sum(amount) AS billed, count(*) AS n, min(pos) AS pos, any_value(description || ': ₹' || format('{:,.2f}', amount::DOUBLE)) FILTER (k = 1) AS top FROM o GROUP BY ALL)
SELECT bill_id, 'EP_' || lpad((row_number() OVER (PARTITION BY bill_id ORDER BY pos, category))::VARCHAR, 3, '0') AS issue_id, category AS issue_type, CASE category WHEN 'SMALL' THEN 'Surgical package' WHEN 'LARGE' THEN 'Room stay' ELSE 'Single items' END AS description, billed::DOUBLE AS billed, 'low' AS confidence,
  'Share of bill: ' || format('{:,.1f}', (billed * 100)::DOUBLE / whole::DOUBLE) || '%; ' || top AS first_two, (1 + least(n, 2) + CASE WHEN n > 2 THEN 1 ELSE 0 END)::INTEGER AS n_evidence FROM p JOIN w USING (bill_id)""",
    "late_claim_citations": CLAIMS
    + "SELECT bill_id, 'Settled after ' || (decision_date - discharge_date) || ' days' || CASE WHEN decision_date - discharge_date > 60 THEN '; Over sixty days' ELSE '' END || '; Regulation: Delay in claims settlement bears interest' AS evidence FROM claims WHERE decision_date - discharge_date > 15",
    "flexible_fields": BRIDGE
    + "SELECT bill_id, pos, CASE WHEN code % 2 = 0 THEN category WHEN code % 3 = 0 THEN 'kind' ELSE 'UNKNOWN_TYPE' END AS issue_type, amount::DOUBLE AS amount, CASE WHEN code % 5 <> 0 THEN description ELSE '' END AS description FROM li WHERE contains(description, 'rod') OR contains(description, 'gear')",
    "code_rows": BRIDGE
    + ", c AS (SELECT code % 3 <> 0 AND type <> 'SMALL' AS ok, brand NOT LIKE '%1' AS priced FROM bench) SELECT 'code' AS step, count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_dropped FROM c UNION ALL SELECT 'price', count(*) FILTER (ok AND priced), count(*) FILTER (ok AND NOT priced) FROM c",
    "component_map": BRIDGE + ", t AS (SELECT type AS device, split_part(name, ' ', 2) AS component, max(rate) AS rate FROM bench GROUP BY ALL) SELECT device, count(*)::INTEGER AS n, string_agg(component, ',' ORDER BY component) AS components, max(rate) FILTER (component = 'gear')::DOUBLE AS gear FROM t GROUP BY device",
}

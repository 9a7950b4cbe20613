"""Queries of the detectors over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import pricing as P
from ..sources.bridge import BRIDGE, benchmarks, bills, discharge_procedures, line_items, table

CONSULTS = ("plate", "gear")
PROCEDURES = ("anvil",)
STOP = ("small", "large")
#: Bands of amounts for the order priorities, in the shape of the department bands.
BANDS = (("1-URGENT", 1, 20000, 30000, 12000), ("1-URGENT", 2, 40000, 60000, 20000), ("2-HIGH", 1, 10000, 45000, 9000), ("3-MEDIUM", 1, 30000, 50000, 25000), ("3-MEDIUM", 2, 5000, 90000, 4000))
LIMITS = {"settle_days": 60, "ship_days": 30, "quantity_days": 40}


def similarity(items):
    """Stands for text similarity: the part size classes give the lines steps between 0.50 and 0.99."""
    return items.withColumn("similarity", (F.lit(50) + F.col("code") % 50).cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)")).withColumn("similarity", F.col("similarity").cast("decimal(5,2)")).withColumn("bench_amount", F.col("rate") * F.col("quantity"))


SIMILAR = BRIDGE + ", s AS (SELECT *, CAST((50 + code % 50) / 100.0::DOUBLE AS DECIMAL(5,2)) AS similarity, rate * quantity AS bench_amount FROM li)"
ISSUE_SQL = "bill_id, pos, '{kind}' AS issue_type, description, amount::DOUBLE AS billed, ({ref})::DOUBLE AS benchmark, (amount - ({ref}))::DOUBLE AS overcharge, '{conf}' AS confidence"


def code_match(spark, d):
    m = D.code_match(line_items(spark, d), benchmarks(spark, d))
    return m.groupBy("matched").agg(F.count("*").alias("n_lines"), F.sum("amount").cast("double").alias("billed"), F.max("bench_rate").cast("double").alias("top_rate"))


def procedure_overcharge(spark, d):
    return D.procedure_overcharge(similarity(line_items(spark, d)))


def mrp_violation(spark, d):
    return D.mrp_violation(line_items(spark, d))


def ceiling_violation(spark, d):
    """Devices above 1.05, drugs above 1.2 times the ceiling; pharmacy lines above 1.1 times ceiling and quantity."""
    items = line_items(spark, d)
    reference = F.col("rate") * F.col("quantity")
    device = D.above(items.filter("category = 'MEDIUM'"), reference, "1.05", "device_overcharge")
    drug = D.above(items.filter("category = 'SMALL'"), reference, "1.2", "drug_overcharge")
    pharmacy = D.above(items.filter("category = 'PROMO'"), reference, "1.1", "drug_overcharge", "medium")
    return device.unionByName(drug).unionByName(pharmacy)


def arithmetic_check(spark, d):
    return D.arithmetic_errors(line_items(spark, d))


def duplicate_lines(spark, d):
    return D.duplicate_lines(line_items(spark, d).withColumn("batch_no", F.lit("")))


def keep_first(spark, d):
    return D.keep_first(line_items(spark, d), ["bill_id", "category"], ["pos"]).select("bill_id", "category", "pos", F.col("amount").cast("double").alias("amount"))


def bill_reconciliation(spark, d):
    return D.reconciled(bills(spark, d), line_items(spark, d))


def total_mismatch(spark, d):
    return D.total_mismatch(bills(spark, d), line_items(spark, d))


def output_validation(spark, d):
    return D.output_validation(bills(spark, d), line_items(spark, d))


def _documented(items):
    return discharge_procedures(items)


def keyword_theta_join(spark, d):
    items = line_items(spark, d)
    return D.procedure_charges(items, _documented(items), PROCEDURES, stop_words=STOP, least=4).select("bill_id", "pos", "description", F.col("amount").cast("double").alias("amount"), "n_procedures", F.array_join("keywords", ",").alias("keywords"))


def positional_discount(spark, d):
    items = line_items(spark, d)
    return D.positional_discount(items, _documented(items), PROCEDURES, stop_words=STOP)


def phantom_consults(spark, d):
    items = line_items(spark, d)
    return D.phantom_consultations(items, _documented(items), CONSULTS)


def claims(spark, d):
    o = bills(spark, d)
    per = line_items(spark, d).groupBy("bill_id").agg(F.max("service_date").alias("decision_date"), F.min("service_date").alias("first_date"), F.sum("quantity").alias("q"), F.sum(F.when(F.col("flag") == "R", F.col("amount"))).alias("rejected"))
    return o.join(per, "bill_id").withColumn("discharge_date", F.col("bill_date"))


CLAIMS = BRIDGE + """, claims AS (
  SELECT bill_id, bill_date AS discharge_date, decision_date, first_date, q, rejected FROM bills
  JOIN (SELECT bill_id, max(service_date) AS decision_date, min(service_date) AS first_date, sum(quantity) AS q, sum(amount) FILTER (flag = 'R') AS rejected FROM li GROUP BY bill_id) USING (bill_id)
)"""


def late_settlement(spark, d):
    return D.late_settlements(claims(spark, d)).select("bill_id", "days", F.col("rejected").cast("double").alias("rejected"))


def sla_breaches(spark, d):
    c = claims(spark, d).select("bill_id", F.date_diff("decision_date", "discharge_date").alias("settle_days"), F.date_diff("first_date", "discharge_date").alias("ship_days"), F.col("q").cast("int").alias("quantity_days"))
    return D.sla_breaches(c, LIMITS)


def _bands(spark):
    return spark.createDataFrame(BANDS, "department string, band int, min_amount int, max_amount int, band_rate int")


def _with_department(spark, d):
    return line_items(spark, d).join(bills(spark, d).select("bill_id", "department"), "bill_id")


def band_heuristic(spark, d):
    hit = D.band_matches(_with_department(spark, d), _bands(spark))
    return hit.select("bill_id", "pos", "band", F.col("amount").cast("double").alias("billed"), F.col("band_rate").cast("double").alias("benchmark"))


def fallback_cascade(spark, d):
    bands = _bands(spark)
    cols = ["bill_id", "pos", "step", "billed", "benchmark"]
    billed = F.col("amount").cast("double").alias("billed")

    def synonym(items):
        hit = items.filter(F.contains("description", F.lit("ring")) & (F.col("amount") > F.col("rate") * F.col("quantity") * D.num("1.5")))
        return hit.select("bill_id", "pos", F.lit("synonym").alias("step"), billed, (F.col("rate") * F.col("quantity")).cast("double").alias("benchmark"))

    def band(items):
        return D.band_matches(items, bands).select("bill_id", "pos", F.lit("band").alias("step"), billed, F.col("band_rate").cast("double").alias("benchmark"))

    def review(items):
        return items.filter("amount >= 5000").select("bill_id", "pos", F.lit("review").alias("step"), billed, F.lit(None).cast("double").alias("benchmark"))

    return D.cascade(_with_department(spark, d), synonym, band, review).select(cols)


def unmatched_anti(spark, d):
    items = line_items(spark, d)
    found = D.mrp_violation(items)
    return D.unmatched(items, found).groupBy("category").agg(F.count("*").alias("n_lines"), F.sum("amount").cast("double").alias("amount"))


def device_fallback_left(spark, d):
    """Devices without a price of their own fall back on twice the common rate."""
    items, s = line_items(spark, d).filter(F.contains("description", F.lit("rod"))), table(spark, d, "supplier")
    own = s.filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("batch_no"), (F.col("s_acctbal").cast("decimal(12,2)") * 2).alias("device_rate"))
    return P.fallback_rates(items, own, "batch_no", F.col("rate") * 2)


KEYWORDS_SQL = """, docs AS (SELECT DISTINCT bill_id, description AS procedure FROM li WHERE line_status = 'F'),
kw AS (
  SELECT bill_id, count(*) AS n_procedures, list_sort(list_distinct(flatten(list(list_filter(string_split(lower(procedure), ' '), lambda w: length(w) >= {least} AND w NOT IN ('small', 'large')))))) AS keywords FROM docs GROUP BY bill_id
), ch AS (
  SELECT li.*, n_procedures, keywords FROM li JOIN kw USING (bill_id)
  WHERE amount > 0 AND (contains(lower(description), 'anvil') OR len(list_filter(keywords, lambda k: contains(lower(description), k))) > 0)
)
"""
BANDS_SQL = ", bands(department, band, min_amount, max_amount, band_rate) AS (VALUES " + ", ".join(map(str, BANDS)) + "), bm AS (SELECT *, row_number() OVER (PARTITION BY bill_id, pos ORDER BY band) AS turn FROM li JOIN bills USING (bill_id) JOIN bands USING (department) WHERE amount >= min_amount AND amount <= max_amount * 1.5 AND amount > band_rate * 1.5)"

QUERIES = {
    f.__name__: f
    for f in (code_match, procedure_overcharge, mrp_violation, ceiling_violation, arithmetic_check, duplicate_lines, keep_first, bill_reconciliation, total_mismatch, output_validation, keyword_theta_join,
              positional_discount, phantom_consults, late_settlement, sla_breaches, band_heuristic, fallback_cascade, unmatched_anti, device_fallback_left)
}
ORACLE_SQL = {
    "code_match": BRIDGE + "SELECT name AS matched, count(*) AS n_lines, sum(amount)::DOUBLE AS billed, max(bench.rate)::DOUBLE AS top_rate FROM li LEFT JOIN bench USING (code) GROUP BY name",
    "procedure_overcharge": SIMILAR
    + """ SELECT bill_id, pos, CASE WHEN similarity >= 0.65 THEN 'procedure_overcharge' ELSE 'missing_itemization' END AS issue_type, description, amount::DOUBLE AS billed,
  CASE WHEN similarity >= 0.65 THEN bench_amount::DOUBLE END AS benchmark, CASE WHEN similarity >= 0.65 THEN (amount - bench_amount)::DOUBLE END AS overcharge,
  CASE WHEN similarity >= 0.75 THEN 'high' WHEN similarity >= 0.65 THEN 'medium' ELSE 'low' END AS confidence
FROM s WHERE similarity < 0.65 OR amount > bench_amount * CASE WHEN similarity >= 0.75 THEN 1.5 ELSE 2.0 END""",
    "mrp_violation": BRIDGE + "SELECT " + ISSUE_SQL.format(kind="drug_overcharge", ref="rate * quantity", conf="high") + " FROM li WHERE rate > 0 AND quantity > 0 AND amount > rate * quantity * 1.02",
    "ceiling_violation": BRIDGE
    + " UNION ALL ".join(
        "SELECT " + ISSUE_SQL.format(kind=k, ref="rate * quantity", conf=c) + f" FROM li WHERE category = '{t}' AND amount > rate * quantity * {x}"
        for k, t, x, c in (("device_overcharge", "MEDIUM", "1.05", "high"), ("drug_overcharge", "SMALL", "1.2", "high"), ("drug_overcharge", "PROMO", "1.1", "medium"))
    ),
    "arithmetic_check": BRIDGE + "SELECT " + ISSUE_SQL.format(kind="duplicate_billing", ref="rate * quantity", conf="medium") + " FROM li WHERE rate * quantity > 0 AND abs(amount - rate * quantity) > greatest(abs(rate * quantity) * 0.05, 1)",
    "duplicate_lines": BRIDGE
    + ", w AS (SELECT *, row_number() OVER o AS turn, first_value(pos) OVER o AS first_pos, first_value(amount) OVER o AS fa FROM li WINDOW o AS (PARTITION BY bill_id, lower(trim(description)) ORDER BY pos)) SELECT bill_id, pos, first_pos, description, '' AS batch_no, amount::DOUBLE AS billed, fa::DOUBLE AS first_billed FROM w WHERE turn > 1",
    "keep_first": BRIDGE + "SELECT bill_id, category, pos, amount::DOUBLE AS amount FROM li QUALIFY row_number() OVER (PARTITION BY bill_id, category ORDER BY pos) = 1",
    "bill_reconciliation": BRIDGE
    + ", s AS (SELECT bill_id, sum(amount) AS line_sum, CAST(sum(amount) * 0.05 AS DECIMAL(18,2)) AS tax FROM li GROUP BY bill_id) SELECT bill_id, bill_total::DOUBLE AS bill_total, line_sum::DOUBLE AS line_sum, tax::DOUBLE AS tax, (bill_total - (line_sum + tax))::DOUBLE AS gap, abs(bill_total - (line_sum + tax)) < 1 AS \"match\" FROM bills JOIN s USING (bill_id)",
    "total_mismatch": BRIDGE
    + ", s AS (SELECT bill_id, sum(amount) AS line_sum FROM li GROUP BY bill_id) SELECT bill_id, bill_total::DOUBLE AS billed, line_sum::DOUBLE AS benchmark, (bill_total - line_sum)::DOUBLE AS difference FROM bills JOIN s USING (bill_id) WHERE abs(bill_total - line_sum) > greatest(line_sum * 0.02, 10)",
    "output_validation": BRIDGE
    + """, s AS (SELECT bill_id, count(*) AS n, count(*) FILTER (amount > 100000) AS lg, count(*) FILTER (amount < 0 AND NOT contains(lower(description), 'return')) AS ng, sum(amount) AS z, count(DISTINCT amount) = 1 AND count(*) > 3 AS eq FROM li GROUP BY bill_id)
SELECT bill_id, coalesce(n, 0) AS n_lines, coalesce(lg, 0) AS n_large, coalesce(ng, 0) AS n_negative, coalesce(bill_total > 0 AND z > 0 AND abs(bill_total - z) * 100 > bill_total * 5, false) AS total_mismatch, coalesce(eq, false) AS all_equal, coalesce(n, 0) > 0 AS is_valid FROM bills LEFT JOIN s USING (bill_id)""",
    "keyword_theta_join": BRIDGE + KEYWORDS_SQL.format(least=4) + "SELECT bill_id, pos, description, amount::DOUBLE AS amount, n_procedures, array_to_string(keywords, ',') AS keywords FROM ch",
    "positional_discount": BRIDGE
    + KEYWORDS_SQL.format(least=5)
    + ", t AS (SELECT bill_id, amount, amount * CASE row_number() OVER (PARTITION BY bill_id ORDER BY amount DESC, pos) WHEN 1 THEN 1.00 WHEN 2 THEN 0.50 ELSE 0.25 END AS e FROM ch WHERE n_procedures >= 2) SELECT bill_id, count(*) AS n_charges, sum(amount)::DOUBLE AS billed, sum(e)::DOUBLE AS expected, (sum(amount) - sum(e))::DOUBLE AS overcharge FROM t GROUP BY bill_id HAVING count(*) >= 2 AND sum(amount) - sum(e) > 100",
    "phantom_consults": BRIDGE
    + ", docs AS (SELECT DISTINCT bill_id, description FROM li WHERE line_status = 'F'), n AS (SELECT bill_id, count(*) AS documented FROM docs GROUP BY bill_id), b AS (SELECT bill_id, count(*) AS billed_count, sum(amount) AS billed FROM li WHERE contains(description, 'plate') OR contains(description, 'gear') GROUP BY bill_id) SELECT bill_id, billed_count, coalesce(documented, 0) AS documented, billed::DOUBLE AS billed, billed::DOUBLE * ((billed_count - coalesce(documented, 0))::DOUBLE / billed_count) AS overcharge FROM b LEFT JOIN n USING (bill_id) WHERE billed_count > coalesce(documented, 0) + 1",
    "late_settlement": CLAIMS + "SELECT bill_id, (decision_date - discharge_date)::INTEGER AS days, rejected::DOUBLE AS rejected FROM claims WHERE decision_date - discharge_date > 15",
    "sla_breaches": CLAIMS
    + " UNION ALL ".join(
        f"SELECT bill_id, '{r}' AS rule, ({x})::BIGINT AS value, {LIMITS[r]} AS allowed FROM claims WHERE {x} > {LIMITS[r]}"
        for r, x in (("settle_days", "(decision_date - discharge_date)"), ("ship_days", "(first_date - discharge_date)"), ("quantity_days", "q::INT"))
    ),
    "band_heuristic": BRIDGE + BANDS_SQL + " SELECT bill_id, pos, band, amount::DOUBLE AS billed, band_rate::DOUBLE AS benchmark FROM bm WHERE turn = 1",
    "fallback_cascade": BRIDGE
    + BANDS_SQL
    + ", syn AS (SELECT bill_id, pos, amount, rate * quantity AS r FROM li JOIN bills USING (bill_id) WHERE contains(description, 'ring') AND amount > rate * quantity * 1.5) SELECT li.bill_id, li.pos, CASE WHEN syn.pos IS NOT NULL THEN 'synonym' WHEN bm.pos IS NOT NULL THEN 'band' ELSE 'review' END AS step, li.amount::DOUBLE AS billed, CASE WHEN syn.pos IS NOT NULL THEN syn.r::DOUBLE WHEN bm.pos IS NOT NULL THEN bm.band_rate::DOUBLE END AS benchmark FROM li JOIN bills USING (bill_id) LEFT JOIN syn ON syn.bill_id = li.bill_id AND syn.pos = li.pos LEFT JOIN bm ON bm.bill_id = li.bill_id AND bm.pos = li.pos AND bm.turn = 1 WHERE syn.pos IS NOT NULL OR bm.pos IS NOT NULL OR li.amount >= 5000",
    "unmatched_anti": BRIDGE + "SELECT category, count(*) AS n_lines, sum(amount)::DOUBLE AS amount FROM li WHERE NOT (rate > 0 AND quantity > 0 AND amount > rate * quantity * 1.02) GROUP BY category",
    "device_fallback_left": BRIDGE
    + ", own AS (SELECT CAST(s_suppkey AS VARCHAR) AS batch_no, CAST(s_acctbal AS DECIMAL(12,2)) * 2 AS dr FROM supplier WHERE s_acctbal > 5000) SELECT bill_id, pos, amount::DOUBLE AS billed, coalesce(dr, rate * 2)::DOUBLE AS benchmark, CASE WHEN dr IS NULL THEN 'common' ELSE 'own' END AS basis FROM li LEFT JOIN own USING (batch_no) WHERE contains(description, 'rod') AND amount > coalesce(dr, rate * 2) * 1.05",
}

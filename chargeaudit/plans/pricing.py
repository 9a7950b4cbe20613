"""Queries of price checks by text, the cascade of fallbacks and sliding request windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import matching as M
from ..operators import pricing as P
from ..sources.bridge import BRIDGE, benchmarks, bills, line_items
from ..streaming import streams
from .detect import BANDS_SQL, _bands, _with_department
from .fields import SYNONYMS, near

SPECIAL = {"words": ("rod",), "question": "small rod of red rod", "must": "rod", "any": ("small", "red")}
REQUESTS = 1


def _told(spark, d):
    """Lines whose texts are more or less like a benchmark's name."""
    text = F.when(F.col("code") % 3 == 0, F.concat("description", F.lit(" strip"))).when(F.col("code") % 3 == 1, F.concat(F.lit("pack of new "), "description")).otherwise(F.col("description"))
    return line_items(spark, d).withColumn("description", F.when(F.col("code") % 11 == 0, "unnamed").otherwise(text))


def _shown(issues):
    return issues.withColumn("evidence", F.array_join("evidence", "; "))


def drug_ceilings(spark, d):
    return _shown(P.drug_ceilings(_told(spark, d), benchmarks(spark, d), "20"))


def device_ceilings(spark, d):
    return _shown(P.device_ceilings(_told(spark, d), benchmarks(spark, d), SPECIAL, "25"))


def lab_rates(spark, d):
    i = _told(spark, d).withColumn("expanded", F.when(F.col("code") % 5 == 0, F.concat("description", F.lit(" kit"))))
    i = i.withColumn("description", F.when(F.col("code") % 13 == 0, F.concat("description", F.lit(" Syringe"))).otherwise(F.col("description")))
    return _shown(P.lab_rates(i, benchmarks(spark, d), ("expanded", "description"), "10", 25))


def unpriced_results(spark, d):
    return P.unpriced_results(bills(spark, d), line_items(spark, d))


def fallback_steps(spark, d):
    """Synonyms by text, then bands of amounts, then reviews of large lines; each line takes the first that has something to say."""
    cols = ["bill_id", "pos", "step", "billed", "benchmark"]
    b = benchmarks(spark, d)
    synonym = lambda i: M.synonym_overcharges(i, b, "department", SYNONYMS, 20.0).withColumn("step", F.lit("synonym")).select(cols)
    band = lambda i: D.band_matches(i, _bands(spark)).select("bill_id", "pos", F.lit("band").alias("step"), F.col("amount").cast("double").alias("billed"), F.col("band_rate").cast("double").alias("benchmark"))
    review = lambda i: i.filter("amount >= 5000").select("bill_id", "pos", F.lit("review").alias("step"), F.col("amount").cast("double").alias("billed"), F.lit(None).cast("double").alias("benchmark"))
    return D.cascade(_with_department(spark, d), synonym, band, review).select(cols)


def request_windows(spark, d):
    """Users with more requests in a sliding hour than allowed, as a stream."""
    return streams._plain(streams.run_on_disk(streams.requests_per_window(streams._closed_events(spark, d, "click"), REQUESTS)))


TOLD = BRIDGE + """, told AS (SELECT * REPLACE (CASE WHEN code % 11 = 0 THEN 'unnamed' WHEN code % 3 = 0 THEN description || ' strip' WHEN code % 3 = 1 THEN 'pack of new ' || description ELSE description END AS description) FROM li)"""
RUPEES = "'{}: ₹' || format('{{:,.2f}}', {}::DOUBLE)"
SAID = f"{RUPEES.format('Benchmark', 'm.mr')} || '; ' || {RUPEES.format('Billed', 'm.amount')} || '; Matched entry: ' || m.matched"
ISSUE = "SELECT bill_id, pos, {kind} AS issue_type, description, m.amount::DOUBLE AS billed, m.mr::DOUBLE AS benchmark, (m.amount - m.mr)::DOUBLE AS overcharge, {conf} AS confidence, matched, similarity, {said} AS evidence FROM {rows} m"

QUERIES = {f.__name__: f for f in (drug_ceilings, device_ceilings, lab_rates, unpriced_results, fallback_steps, request_windows)}
ORACLE_SQL = {
    "drug_ceilings": TOLD + ", tx AS (SELECT description AS text FROM told)" + near("tx")
    + ", m0 AS (SELECT told.* EXCLUDE rate, r0.name AS matched, r0.rate AS mr, r0.similarity FROM told JOIN r0 ON r0.text = told.description AND r0.rank = 1 WHERE r0.rate > 0 AND amount > r0.rate * 20) "
    + ISSUE.format(kind="'drug_overcharge'", conf="'high'", said=SAID, rows="m0"),
    "device_ceilings": TOLD + f", tx AS (SELECT description AS text FROM told UNION SELECT '{SPECIAL['question']}')" + near("tx")
    + f""", sp AS (SELECT name, rate FROM r0 WHERE text = '{SPECIAL['question']}' AND rank <= 10 AND contains(name, 'rod') AND (contains(name, 'small') OR contains(name, 'red')) ORDER BY rank LIMIT 1),
one AS (SELECT told.* EXCLUDE rate, sp.name AS matched, sp.rate AS mr, 1.0::DOUBLE AS similarity, '; Found by the search for this device' AS note FROM told JOIN sp ON contains(description, 'rod') AND amount > sp.rate * 25),
m0 AS (SELECT * FROM one UNION ALL SELECT told.* EXCLUDE rate, r0.name, r0.rate, r0.similarity, '' FROM told JOIN r0 ON r0.text = told.description AND r0.rank = 1 AND r0.similarity >= 0.5 WHERE amount > r0.rate * 25 AND NOT EXISTS (SELECT 1 FROM one WHERE one.bill_id = told.bill_id AND one.pos = told.pos)) """
    + ISSUE.format(kind="'device_overcharge'", conf="'high'", said=SAID + " || note", rows="m0"),
    "lab_rates": TOLD
    + """, lab AS (SELECT * REPLACE (description || CASE WHEN code % 13 = 0 THEN ' Syringe' ELSE '' END AS description), CASE WHEN code % 5 = 0 THEN description || ' kit' END AS expanded FROM told), ts AS (SELECT * FROM lab WHERE code % 13 <> 0),
a AS (SELECT bill_id, pos, 0 AS source, expanded AS text FROM ts WHERE expanded IS NOT NULL UNION ALL SELECT bill_id, pos, 1, description FROM ts)""" + near("a")
    + """, f AS (SELECT bill_id, pos, name, rate, similarity FROM a JOIN r0 ON a.text = r0.text AND rank = 1 AND similarity >= 0.45 QUALIFY row_number() OVER (PARTITION BY bill_id, pos ORDER BY similarity DESC, source) = 1),
m0 AS (SELECT ts.* EXCLUDE rate, f.name AS matched, f.rate AS mr, f.similarity, CASE WHEN f.similarity >= 0.65 AND amount <= f.rate * 25 THEN 'high' WHEN f.similarity >= 0.55 THEN 'medium' ELSE 'low' END AS level FROM ts LEFT JOIN f USING (bill_id, pos) WHERE f.name IS NULL OR amount > f.rate * 10) """
    + ISSUE.format(kind="CASE WHEN matched IS NULL THEN 'missing_itemization' ELSE 'procedure_overcharge' END", conf="level", rows="m0",
                   said=f"CASE WHEN matched IS NULL THEN {RUPEES.format('Billed', 'm.amount')} || '; No reliable benchmark' ELSE {SAID} || CASE WHEN level <> 'high' THEN '; To be verified before it is disputed' ELSE '' END END"),
    "unpriced_results": BRIDGE + ", s AS (SELECT bill_id, count(*) AS n, sum(amount) AS z FROM li GROUP BY bill_id) SELECT bill_id, coalesce(nullif(bill_total, 0), z, 0)::DOUBLE AS total_bill, coalesce(nullif(bill_total, 0), z, 0)::DOUBLE AS unverified, 0.0::DOUBLE AS verified, 0.0::DOUBLE AS recoverable, coalesce(n, 0) || ' lines were read, without benchmarks' AS summary FROM bills LEFT JOIN s USING (bill_id)",
    "fallback_steps": BRIDGE + BANDS_SQL
    + ", a AS (SELECT bill_id, pos, amount, description, CASE WHEN contains(description, 'widget') THEN replace(description, 'widget', 'small bolt') WHEN contains(description, 'anvil') THEN replace(description, 'anvil', 'old hot rod') WHEN contains(description, 'red') THEN replace(description, 'red', 'crimson') END AS text FROM li), b AS (SELECT * FROM a WHERE text <> description)" + near("b")
    + """, sy AS (SELECT bill_id, pos, r0.rate::DOUBLE AS r FROM b JOIN r0 ON b.text = r0.text AND rank = 1 WHERE amount::DOUBLE > r0.rate::DOUBLE * 20.0::DOUBLE)
SELECT li.bill_id, li.pos, CASE WHEN sy.pos IS NOT NULL THEN 'synonym' WHEN bm.pos IS NOT NULL THEN 'band' ELSE 'review' END AS step, li.amount::DOUBLE AS billed, CASE WHEN sy.pos IS NOT NULL THEN sy.r ELSE bm.band_rate::DOUBLE END AS benchmark
FROM li LEFT JOIN sy USING (bill_id, pos) LEFT JOIN (SELECT * FROM bm WHERE turn = 1) bm ON bm.bill_id = li.bill_id AND bm.pos = li.pos WHERE sy.pos IS NOT NULL OR bm.pos IS NOT NULL OR li.amount >= 5000""",
    "request_windows": f"""WITH w AS (SELECT user_id, unnest(list_transform(range(0, 12), lambda k: time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) - k * INTERVAL 5 MINUTE)) AS start FROM events WHERE ts IS NOT NULL)
SELECT user_id, start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > {REQUESTS}""",
}

"""Queries of warnings about what was read, amounts that are no numbers, and saved search results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import detect as D
from ..sources import files as S
from ..sources.bridge import BRIDGE, benchmarks, bills, line_items, shared_folder


def output_warnings(spark, d):
    """Bills with what is odd about them: dear, negative and equal lines, totals that are away, missing fields, no lines."""
    b = bills(spark, d)
    named = b.select("bill_id", "bill_total", F.when(F.col("bill_id") % 3 == 0, "  ").otherwise("City").alias("hospital_name"), F.col("bill_id").alias("bill_number"), F.when(F.col("bill_id") % 5 != 0, "Anna").alias("patient_name"))
    sign = F.when((F.col("code") % 9 == 0) & (F.col("pos") > 1), -1).otherwise(1)
    amount = F.when(F.col("bill_id") % 4 == 0, F.lit(7)).when(F.col("code") % 10 == 3, F.lit(None)).otherwise(F.col("amount") * sign)
    name = F.when(F.col("code") % 2 == 0, F.concat("description", F.lit(" Return"))).otherwise(F.col("description"))
    items = line_items(spark, d).filter("bill_id % 7 <> 0").select("bill_id", "pos", amount.cast("decimal(12,2)").alias("amount"), name.alias("description"))
    return D.output_warnings(named, items, large="60000").withColumn("warnings", F.array_join("warnings", " | "))


def raw_amounts(spark, d):
    """Lines whose amounts are text, by what becomes of them."""
    raw = F.element_at(F.array(F.lit("n/a"), F.lit(None), F.lit("0"), F.lit("-5"), F.lit("NaN"), F.concat(F.lit(" "), F.col("amount").cast("string"), F.lit(" "))), (F.col("code") % 6 + 1).cast("int"))
    good, bad = D.numeric_lines(line_items(spark, d).withColumn("amount", raw))
    return good.agg(F.lit("kept").alias("what"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("total")).unionByName(bad.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


def search_results(spark, d):
    """Saved searches, one for each brand, written and read as JSON, the three best results of each."""
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}/results"
    score = F.when(F.col("code") % 17 != 0, (F.col("code") * 7919) % 1000 / 1000)
    one = F.struct(F.concat(F.lit("http://x/"), "code").alias("url"), F.col("name").alias("title"), F.col("type").alias("content"), score.alias("score"))
    benchmarks(spark, d).groupBy(F.col("brand").alias("query")).agg(F.collect_list(one).alias("results")).write.json(path)
    return S.search_results(spark, path).filter("rank <= 3")


_W = "'₹' || format('{{:,.2f}}', {}::DOUBLE)"
QUERIES = {f.__name__: f for f in (output_warnings, raw_amounts, search_results)}
ORACLE_SQL = {
    "output_warnings": BRIDGE
    + f""", l AS (SELECT bill_id, pos, coalesce(CASE WHEN bill_id % 4 = 0 THEN 7 WHEN code % 10 = 3 THEN NULL ELSE amount * CASE WHEN code % 9 = 0 AND pos > 1 THEN -1 ELSE 1 END END, 0)::DECIMAL(12,2) AS a, code % 2 = 0 AS r FROM li WHERE bill_id % 7 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY pos) AS i FROM l),
w AS (SELECT bill_id, string_agg(CASE WHEN a > 60000 THEN 'Line ' || i || ' has an unusually high amount: ' || {_W.format('a')} WHEN a < 0 AND NOT r THEN 'Line ' || i || ' is negative and no return' END, ' | ' ORDER BY i) AS t, sum(a)::DOUBLE AS z, count(DISTINCT a) = 1 AND count(*) > 3 AS same FROM n GROUP BY bill_id)
SELECT bill_id, w.bill_id IS NOT NULL AS is_valid, CASE WHEN w.bill_id IS NULL THEN 'No lines were read' ELSE concat_ws(' | ', t,
  CASE WHEN bill_total > 0 AND z > 0 AND abs(bill_total::DOUBLE - z) / bill_total::DOUBLE * 100 > 5 THEN 'The bill says ' || {_W.format('bill_total')} || ', its lines ' || {_W.format('z')} END,
  CASE WHEN bill_id % 3 = 0 OR bill_id % 5 = 0 THEN 'Missing fields: ' || concat_ws(', ', CASE WHEN bill_id % 3 = 0 THEN 'hospital_name' END, CASE WHEN bill_id % 5 = 0 THEN 'patient_name' END) END,
  CASE WHEN same THEN 'All lines have the same amount' END) END AS warnings FROM bills LEFT JOIN w USING (bill_id)""",
    "raw_amounts": BRIDGE + "SELECT 'kept' AS what, count(*) AS n, sum(amount)::DOUBLE AS total FROM li WHERE code % 6 = 5 UNION ALL SELECT 'missing_or_invalid_amount', count(*), NULL FROM li WHERE code % 6 IN (0, 1, 4)",
    "search_results": BRIDGE
    + "SELECT brand AS query, 'http://x/' || code AS url, name AS title, type AS content, CASE WHEN code % 17 <> 0 THEN ((code * 7919) % 1000)::DOUBLE / 1000 END AS score, (row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN code % 17 <> 0 THEN ((code * 7919) % 1000)::DOUBLE / 1000 END DESC NULLS LAST, 'http://x/' || code))::INTEGER AS rank FROM bench QUALIFY rank <= 3",
}

"""Queries of operators on stored tables, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables as T
from ..operators.pricing import single_threshold
from ..sources.bridge import BRIDGE, benchmarks, bills, line_items, table
from ..streaming import streams

FACTORS = [("category", {"ECONOMY": "0.8", "STANDARD": "0.9", "PROMO": "1.15"}), ("flag", {"R": "0.95", "A": "1.05"})]
CAPS = {"ECONOMY": 950, "SMALL": 1000, "PROMO": 1050}


def drug_index_lookup(spark, d):
    index = T.name_index(benchmarks(spark, d))
    names = line_items(spark, d).select("bill_id", "pos", F.lower("description").alias("key"))
    per = index.groupBy("key").agg(F.count("*").alias("n_entries"), F.max("rate").cast("double").alias("top_rate"))
    return names.join(per.hint("merge"), "key").groupBy("key", "n_entries", "top_rate").agg(F.count("*").alias("n_lines"))


def substring_fallback(spark, d):
    index = T.name_index(benchmarks(spark, d))
    names = line_items(spark, d).select(F.split_part("description", F.lit(" "), F.lit(2)).alias("name")).distinct()
    return T.substring_fallback(names, index)


def fk_join(spark, d):
    per = line_items(spark, d).groupBy("bill_id").agg(F.count("*").alias("n_lines"), F.sum("amount").cast("double").alias("amount"))
    return bills(spark, d).join(per, "bill_id").select("bill_id", "patient_id", "n_lines", "amount")


def ownership_semijoin(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("patient_id"))
    return T.owned(bills(spark, d), c, "patient_id").select("bill_id", "patient_id", F.col("bill_total").cast("double").alias("bill_total"))


def multi_bill_union(spark, d):
    return T.merged_bills(bills(spark, d), F.col("patient_id"))


def page_merge(spark, d):
    pages = line_items(spark, d).select("bill_id", F.col("pos").alias("page"), F.when(F.col("pos") % 2 == 0, F.col("amount")).otherwise(F.lit(0)).cast("decimal(12,2)").alias("page_total"), F.col("amount").alias("page_amount"))
    return T.merged_pages(pages.filter("page > 1 OR bill_id % 2 = 0"), "bill_id", "page")


def partial_failure(spark, d):
    per = bills(spark, d).groupBy("patient_id").agg(F.count("*").alias("n_bills"), F.count_if(F.col("status") == "P").alias("n_failed"))
    return per.filter("n_failed > 0").select("patient_id", F.format_string("%d of %d bills could not be read", "n_failed", "n_bills").alias("warning"))


def status_counts(spark, d):
    return line_items(spark, d).groupBy("bill_id").agg(*[F.count_if(F.col("flag") == f).alias(n) for f, n in (("A", "approved"), ("N", "partial"), ("R", "rejected"))])


def dispute_reconciliation(spark, d):
    per = line_items(spark, d).groupBy("bill_id").agg(F.sum(F.col("amount") - (F.col("amount") * (1 - F.col("discount"))).cast("decimal(18,2)")).alias("disputed"))
    j = bills(spark, d).join(per, "bill_id").withColumn("reported", F.when(F.col("bill_id") % 4 == 0, F.col("disputed")).when(F.col("bill_id") % 4 == 1, F.lit(None).cast("decimal(18,2)")).otherwise((F.col("bill_total") * F.lit(2)).cast("decimal(18,2)")))
    gap = F.col("disputed") - F.col("reported")
    return j.select("bill_id", F.col("disputed").cast("double").alias("disputed"), T.dispute_text(gap, F.col("reported")).alias("reading"))


def histogram(spark, d):
    return line_items(spark, d).groupBy("category", "flag").agg(F.count("*").alias("n_lines"), F.count_distinct("code").alias("n_codes"))


def first_k_per_section(spark, d):
    w = Window.partitionBy("bill_id", "category").orderBy(F.desc("amount"), "pos")
    r = line_items(spark, d).select("*", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("bill_id", "category")).alias("n"))
    return r.filter("place <= 2").select("bill_id", "category", "place", "pos", F.greatest(F.col("n") - 2, F.lit(0)).alias("more"))


def upsert_coalesce(spark, d):
    b = benchmarks(spark, d).select("code", "name", F.col("rate").cast("double").alias("rate"))
    new = b.filter("code % 3 = 0").select((F.col("code") + 100).alias("code"), F.when(F.col("code") % 2 == 0, F.upper("name")).alias("name"))
    return T.upserted(b, new, "code")


def union_provenance(spark, d):
    b = benchmarks(spark, d).select("code", "name", F.col("rate").cast("double").alias("rate"))
    return T.united(("regulator", b.filter("code % 2 = 0")), ("supplement", b.filter("code % 5 = 0")))


def list_difference(spark, d):
    i = line_items(spark, d)
    per = i.groupBy("bill_id").agg(F.collect_set("category").alias("own"))
    all_ = F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))
    return per.select("bill_id", F.array_join(F.array_except(all_, "own"), ",").alias("missing"))


def component_price(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("device"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("component"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return T.components(p)


def sentinel_mean(spark, d):
    e = table(spark, d, "events").withColumn("conf", F.when(F.col("event_id") % 4 == 0, F.lit(-1.0)).otherwise(F.floor("value")))
    per = e.groupBy("user_id", "event_type").agg(T.sentinel_mean(F.col("conf")).alias("m"), F.count("*").alias("n"))
    return per.select("user_id", "event_type", "n", F.round("m", 6).alias("mean"))


def benchmark_adjust(spark, d):
    i = line_items(spark, d)
    return i.select("bill_id", "pos", T.adjusted(i, FACTORS).alias("adjusted"))


def room_cap(spark, d):
    cap = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in CAPS.items()])
    return line_items(spark, d).filter(F.col("rate") > cap).select("bill_id", "pos", F.col("rate").cast("double").alias("rate"), cap.alias("cap"))


def rules_v1(spark, d):
    """The older single threshold: 1.5 times the rate for every kind, devices first."""
    kinds = {"device": ("rod",), "room": ("plate",), "diagnostic": ("gear",), "consultation": ("ring",)}
    return single_threshold(line_items(spark, d), kinds, F.col("rate") * F.col("quantity"))


def rate_limit(spark, d):
    return streams.over_limit(table(spark, d, "events"), 2)


def running_totals(spark, d):
    return streams.totals(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


FACTOR_SQL = " * ".join("CASE " + c + "".join(f" WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in t.items()) + " ELSE 1.0::DOUBLE END" for c, t in FACTORS)
QUERIES = {
    f.__name__: f
    for f in (drug_index_lookup, substring_fallback, fk_join, ownership_semijoin, multi_bill_union, page_merge, partial_failure, status_counts, dispute_reconciliation, histogram, first_k_per_section, upsert_coalesce,
              union_provenance, list_difference, component_price, sentinel_mean, benchmark_adjust, room_cap, rules_v1, rate_limit, running_totals)
} | {"audit_stream": streams.audit_stream, "sla_stream": streams.sla_stream, "dedup_stream": streams.dedup_stream, "stuck_stream": streams.stuck_stream}
IDX = ", idx AS (SELECT DISTINCT lower(name) AS key, code, rate FROM bench UNION SELECT lower(split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1)), code, rate FROM bench)"
ORACLE_SQL = {
    "drug_index_lookup": BRIDGE + IDX + ", per AS (SELECT key, count(*) AS n_entries, max(rate)::DOUBLE AS top_rate FROM idx GROUP BY key) SELECT key, n_entries, top_rate, count(*) AS n_lines FROM li JOIN per ON lower(description) = key GROUP BY ALL",
    "substring_fallback": BRIDGE + IDX + ", n AS (SELECT DISTINCT split_part(description, ' ', 2) AS name FROM li), k AS (SELECT DISTINCT key FROM idx) SELECT name, key FROM n JOIN k ON contains(key, name) WHERE name NOT IN (SELECT key FROM k)",
    "fk_join": BRIDGE + "SELECT bill_id, patient_id, count(*) AS n_lines, sum(amount)::DOUBLE AS amount FROM bills JOIN li USING (bill_id) GROUP BY ALL",
    "ownership_semijoin": BRIDGE + "SELECT bill_id, patient_id, bill_total::DOUBLE AS bill_total FROM bills WHERE patient_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "multi_bill_union": BRIDGE + "SELECT patient_id AS upload_id, count(*) AS n_bills, sum(bill_total)::DOUBLE AS total, min(bill_date)::VARCHAR AS first_date, string_agg(bill_id::VARCHAR, ', ' ORDER BY bill_id) AS numbers, arg_min(department, bill_id) AS department FROM bills GROUP BY patient_id",
    "page_merge": BRIDGE + ", p AS (SELECT bill_id, pos, CASE WHEN pos % 2 = 0 THEN amount ELSE 0 END AS t, amount FROM li WHERE pos > 1 OR bill_id % 2 = 0) SELECT bill_id, count(*) AS n_pages, coalesce(nullif(arg_min(t, pos), 0), sum(amount))::DOUBLE AS total FROM p GROUP BY bill_id",
    "partial_failure": BRIDGE + "SELECT patient_id, count(*) FILTER (status = 'P') || ' of ' || count(*) || ' bills could not be read' AS warning FROM bills GROUP BY patient_id HAVING count(*) FILTER (status = 'P') > 0",
    "status_counts": BRIDGE + "SELECT bill_id, count(*) FILTER (flag = 'A') AS approved, count(*) FILTER (flag = 'N') AS partial, count(*) FILTER (flag = 'R') AS rejected FROM li GROUP BY bill_id",
    "dispute_reconciliation": BRIDGE
    + ", p AS (SELECT bill_id, sum(amount - CAST(amount * (1 - discount) AS DECIMAL(18,2))) AS disputed FROM li GROUP BY bill_id), r AS (SELECT bill_id, disputed, CASE bill_id % 4 WHEN 0 THEN disputed WHEN 1 THEN NULL ELSE bill_total * 2 END AS reported FROM bills JOIN p USING (bill_id)) SELECT bill_id, disputed::DOUBLE AS disputed, CASE WHEN reported IS NULL THEN 'cannot reconcile' WHEN abs(disputed - reported) < 1 THEN 'exact match' WHEN disputed - reported > 1 THEN 'sum exceeds reported by ' || format('{:,.0f}', (disputed - reported)::DOUBLE) ELSE 'sum less than reported by ' || format('{:,.0f}', (reported - disputed)::DOUBLE) END AS reading FROM r",
    "histogram": BRIDGE + "SELECT category, flag, count(*) AS n_lines, count(DISTINCT code) AS n_codes FROM li GROUP BY ALL",
    "first_k_per_section": BRIDGE + "SELECT bill_id, category, row_number() OVER w AS place, pos, greatest(count(*) OVER (PARTITION BY bill_id, category) - 2, 0) AS more FROM li WINDOW w AS (PARTITION BY bill_id, category ORDER BY amount DESC, pos) QUALIFY row_number() OVER w <= 2",
    "upsert_coalesce": BRIDGE + ", n AS (SELECT code + 100 AS code, CASE WHEN code % 2 = 0 THEN upper(name) END AS name FROM bench WHERE code % 3 = 0) SELECT coalesce(bench.code, n.code) AS code, coalesce(n.name, bench.name) AS name, rate::DOUBLE AS rate FROM bench FULL JOIN n ON bench.code = n.code",
    "union_provenance": BRIDGE + "SELECT code, name, rate::DOUBLE AS rate, 'regulator' AS data_source FROM bench WHERE code % 2 = 0 UNION ALL SELECT code, name, rate::DOUBLE, 'supplement' FROM bench WHERE code % 5 = 0",
    "list_difference": BRIDGE + ", p AS (SELECT bill_id, list(DISTINCT category) AS own FROM li GROUP BY bill_id) SELECT bill_id, array_to_string(list_filter(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], lambda c: NOT list_contains(own, c)), ',') AS missing FROM p",
    "component_price": "WITH t AS (SELECT p_type AS device, split_part(p_name, ' ', 2) AS component, max(CAST(p_retailprice AS DECIMAL(12,2))) AS price FROM part GROUP BY ALL) SELECT device, sum(price)::DOUBLE AS total, count(*) AS n_components FROM t GROUP BY device",
    "sentinel_mean": "SELECT user_id, event_type, count(*) AS n, round(avg(CASE WHEN event_id % 4 <> 0 THEN nullif(floor(value), -1) END), 6) AS mean FROM events GROUP BY ALL",
    "benchmark_adjust": BRIDGE + f"SELECT bill_id, pos, rate::DOUBLE * {FACTOR_SQL} AS adjusted FROM li",
    "room_cap": BRIDGE + "SELECT bill_id, pos, rate::DOUBLE AS rate, CASE category WHEN 'ECONOMY' THEN 950 WHEN 'SMALL' THEN 1000 WHEN 'PROMO' THEN 1050 END AS cap FROM li WHERE rate > CASE category WHEN 'ECONOMY' THEN 950 WHEN 'SMALL' THEN 1000 WHEN 'PROMO' THEN 1050 END",
    "rules_v1": BRIDGE + "SELECT bill_id, pos, kind, amount::DOUBLE AS billed, (rate * quantity)::DOUBLE AS benchmark FROM (SELECT *, CASE WHEN contains(description, 'rod') THEN 'device' WHEN contains(description, 'plate') THEN 'room' WHEN contains(description, 'gear') THEN 'diagnostic' WHEN contains(description, 'ring') THEN 'consultation' END AS kind FROM li) WHERE kind IS NOT NULL AND amount > rate * quantity * 1.5",
    "rate_limit": "SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2",
    "running_totals": "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total FROM events GROUP BY ALL",
    "sla_stream": "SELECT s.event_id AS request_id, s.user_id, s.ts AS asked, p.event_id AS answer_id FROM events s LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = s.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 1 DAY WHERE s.event_type = 'signup'",
    "dedup_stream": "SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events",
    "stuck_stream": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING count(*) FILTER (event_type = 'purchase') = 0""",
    "audit_stream": "SELECT l_orderkey AS bill_id, l_linenumber, l_extendedprice AS billed, p_retailprice * l_quantity AS benchmark FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 1.5::DOUBLE * p_retailprice * l_quantity",
}

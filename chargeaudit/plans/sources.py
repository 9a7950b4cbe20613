"""Queries of sources, sinks and reference-price columns, over the order tables and documents."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import pages as G
from ..operators import post as P
from ..sources import files as S
from ..sources.bridge import BRIDGE, benchmarks, bills, line_items, table
from ..streaming.streams import _folder
from .post import ISSUES, _analysed, _issues

KINDS = "CASE type WHEN 'ECONOMY' THEN 'cghs_rate' WHEN 'SMALL' THEN 'non_payable' ELSE 'nppa_drug' END"
TOPICS = ("the", "tion", "que")


def _priced(spark, d):
    kind = F.when(F.col("type") == "ECONOMY", "cghs_rate").when(F.col("type") == "SMALL", "non_payable").otherwise("nppa_drug")
    return benchmarks(spark, d).withColumn("kind", kind)


def collection_roundtrip(spark, d):
    """Price rows written as collections by type, one of them replaced, and one read back."""
    path = f"{_folder(spark)}/collections"
    rows = _priced(spark, d).select("code", "name", F.col("rate").cast("double").alias("rate"), F.col("kind").alias("type"))
    S.write_collections(rows, path)
    S.write_collections(rows.filter("type = 'cghs_rate' AND code % 2 = 0"), path)
    return S.collection(spark, path, "cghs_rate").unionByName(S.collection(spark, path, "nppa_drug")).select("code", "name", "rate", "type")


def searchable_text(spark, d):
    p = _priced(spark, d)
    return p.select("code", S.benchmark_text(F.col("kind"), F.col("name"), F.col("rate"), F.col("brand")).alias("text"))


def flat_metadata(spark, d):
    p = _priced(spark, d)
    m = S.flat_metadata({"type": F.col("kind"), "brand": F.when(F.col("code") % 2 == 0, F.col("brand")), "note": F.when(F.col("code") % 3 == 0, F.lit(""))})
    return p.select("code", F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("vals"))


def page_text(spark, d):
    lines = G.lines_of(table(spark, d, "documents")).withColumn("text", F.when(F.col("line") % 4 == 3, F.lit("  ")).otherwise(F.col("text")))
    return S.page_texts(lines, page="line").select("doc_id", "n_pages", "chars", F.md5("full_text").alias("digest"))


def issue_sink(spark, d):
    issues, _ = _issues(spark, d)
    out = S.stored_issues(issues.withColumn("overcharge", F.when(F.col("pos") % 2 == 0, F.lit(0.0)).otherwise(F.col("overcharge"))))
    return out.groupBy("issue_type", "confidence").agg(F.count("*").alias("n"), F.count("overcharge").alias("n_over"), F.sum("billed").cast("double").alias("billed"))


def result_export(spark, d):
    """Results as nested JSON, and the first issue read back from it."""
    analysed, final = _analysed(spark, d)
    j = S.nested(analysed, final, "issue_type", "description", "confidence")
    return j.select("bill_id", F.get_json_object("result", "$.n_issues").cast("long").alias("n_issues"), F.get_json_object("result", "$.issues[0].description").alias("first_issue"), F.get_json_object("result", "$.issues[0].confidence").alias("first_confidence"))


def file_types(spark, d):
    p = table(spark, d, "pages")
    name = F.concat_ws("_", F.element_at(F.array(*map(F.lit, ("scan", "Dis-Sum", "DENIED", "Cert", "hospital", "photo"))), (F.col("page_id") % 6 + 1).cast("int")), F.col("page_id").cast("string"))
    return p.select("page_id", S.file_type(name).alias("file_type"))


def column_roles(spark, d):
    i = line_items(spark, d)
    heads = ("Service Date", "PARTICULARS", "Qty", "Unit Rate", "Net Amount")
    texts = (F.col("service_date").cast("string"), F.concat(F.lit(" "), F.replace("description", F.lit(" "), F.lit("   "))), F.col("quantity").cast("int").cast("string"), F.col("rate").cast("string"), F.col("amount").cast("string"))
    cell = lambda row, k, text: F.struct(row.alias("row"), F.lit(k).alias("col"), text.alias("text"))
    # a bill's first line brings the headings, so cells stay dealt by bill
    own = [cell(F.col("pos"), k, t) for k, t in enumerate(texts)]
    head = [cell(F.lit(0), k, F.lit(t)) for k, t in enumerate(heads)]
    cells = i.select(F.col("bill_id").alias("doc_id"), F.explode(F.when(F.col("pos") == 1, F.array(*head, *own)).otherwise(F.array(*own))).alias("c")).select("doc_id", "c.*")
    return S.cells_to_rows(cells)


def payable_status(spark, d):
    p = table(spark, d, "part")
    said = F.element_at(F.array(*map(F.lit, ("Not Payable", "Payable", "May be payable", "Non-payable but essential", "", "see note", "Essential"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select(S.payable_status(said).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def price_tokens(spark, d):
    i = table(spark, d, "lineitem")
    tokens = F.array(F.lit("MRP"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("12")).otherwise(F.format_number("l_extendedprice", 2)), F.lit("7.5"))
    note = F.when(F.col("l_linenumber") == 1, F.lit("S.O. 1234(E) dated 01.04.2023 x")).when(F.col("l_linenumber") == 2, F.lit("SO 99 (E)")).otherwise(F.lit(" none "))
    return i.select("l_orderkey", "l_linenumber", S.first_price(tokens).alias("price"), S.notification(note).alias("notification"))


def price_buckets(spark, d):
    i = line_items(spark, d)
    b = S.bucketed(F.col("amount"), [(10000, "small"), (30000, "middle"), (60000, "large")], "huge")
    return i.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.max("amount").cast("double").alias("top"))


def parse_quality(spark, d):
    i = line_items(spark, d)
    garbled = F.when(F.col("code") % 4 == 0, F.lit("#1|2 %%9 x")).when(F.col("code") % 9 == 0, F.lit("ab")).otherwise(F.col("description"))
    return S.parse_quality(i.withColumn("description", garbled))


def consumables(spark, d):
    i = line_items(spark, d)
    hit = i.filter((F.col("amount") > 10000) & F.contains("description", F.lit("gizmo")))
    return hit.select("bill_id", "pos", F.col("amount").cast("double").alias("billed"), F.lit("medium").alias("confidence"))


def lab_overcharge(spark, d):
    """1.5 times the rate; the ladder of 0.65, 0.55 and 0.45; more than five times lowers high to medium; lines without a match are reviewed."""
    i = line_items(spark, d).filter("category IN ('LARGE', 'MEDIUM')").withColumn("similarity", (F.lit(40) + F.col("code") % 40).cast("int"))
    ref = F.col("rate") * F.col("quantity")
    level = F.when(F.col("similarity") >= 65, F.when(F.col("amount").cast("double") / ref.cast("double") > 5.0, "medium").otherwise("high")).when(F.col("similarity") >= 55, "medium").otherwise("low")
    matched = F.col("similarity") >= 45
    hit = i.filter(~matched | (F.col("amount") > ref * F.lit(Decimal("1.5"))))
    return hit.select("bill_id", "pos", F.when(matched, "procedure_overcharge").otherwise("missing_itemization").alias("issue_type"), F.when(matched, level).otherwise("low").alias("confidence"), F.col("amount").cast("double").alias("billed"), F.when(matched, ref.cast("double")).alias("benchmark"))


def suppress_consults(spark, d):
    """Consultations whose text begins like an earlier line of the same bill and category go."""
    return D.unrepeated(line_items(spark, d), ["bill_id", "category"]).select("bill_id", "pos", "description")


def repeated_consults(spark, d):
    """Consultations that an earlier line of the bill has with the same base text and amount go."""
    i = line_items(spark, d).withColumn("amount", F.floor(F.col("amount") / 10000))
    return D.unrepeated(i, ["bill_id", "amount"]).select("bill_id", "pos", "description")


def first_prices(spark, d):
    """The first price of each description by code, then the first description of each price."""
    b = benchmarks(spark, d)
    one = D.keep_first(b, ["name"], ["code"])
    return D.keep_first(one, ["rate"], ["code"]).select("name", "code", F.col("rate").cast("double").alias("rate"))


def special_match(spark, d):
    """Lines of one device matched to the best row of a fixed search, found once."""
    best = benchmarks(spark, d).filter("name = 'small rod'").orderBy("code").limit(1).select(F.col("code").alias("matched"), F.col("rate").alias("ceiling"))
    i = line_items(spark, d).filter("description LIKE '%rod'")
    j = i.join(F.broadcast(best), F.col("amount") > F.col("ceiling") * F.col("quantity") * F.lit(Decimal("1.05")))  # one row
    return j.select("bill_id", "pos", "matched", F.col("amount").cast("double").alias("billed"), (F.col("ceiling") * F.col("quantity")).cast("double").alias("benchmark"))


def lookup_format(spark, d):
    """For each department the three highest lines as one numbered text."""
    i = line_items(spark, d).join(bills(spark, d).select("bill_id", "department"), "bill_id")
    top = i.select("*", F.row_number().over(Window.partitionBy("department").orderBy(F.desc("amount"), "bill_id", "pos")).alias("n")).filter("n <= 3")
    line = F.concat(F.lit("["), "n", F.lit("] "), "description", F.lit(": "), P.rupees(F.col("amount")))
    return top.groupBy("department").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def cited_regulations(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(P.cited(F.col("text"), {"the": "Rate schedule", "tion": "Price orders", "que": "Master circular"}), "; ").alias("cited"))


def assessment_rows(spark, d):
    i = line_items(spark, d)
    settled = (F.col("amount") * (1 - F.col("discount"))).cast("decimal(18,2)")
    rows = i.select(
        F.col("bill_id").alias("doc_id"), F.col("pos").alias("row"), F.concat(F.lit(" "), "description", F.lit("  x ")).alias("description"), F.concat(F.lit("raft"), F.format_number("amount", 2)).alias("claimed"), settled.cast("string").alias("settled"),
        F.element_at(F.array(*map(F.lit, ("partially appro", "Rejected", "Approved in full", "open"))), (F.col("code") % 4 + 1).cast("int")).alias("status"), F.when(F.col("code") % 2 == 0, "VECDlause 4").otherwise("lause 5").alias("clause"),
    )
    return S.assessments(rows)


def section_registry(spark, d):
    final = P.deduplicated(_issues(spark, d)[0])
    r = P.Sections()
    r.register("drugs", F.col("issue_type") == "drug_overcharge", F.concat(F.lit("Drugs: "), "n"), 50)
    r.register("sure", F.col("confidence") == "high", F.concat(F.lit("Confirmed: "), "n", F.lit(" over "), F.format_number("total", 2)), 100)
    return r.written(final)


QUERIES = {
    f.__name__: f
    for f in (collection_roundtrip, searchable_text, flat_metadata, page_text, issue_sink, result_export, file_types, column_roles, payable_status, price_tokens, price_buckets, parse_quality, consumables, lab_overcharge,
              suppress_consults, repeated_consults, first_prices, special_match, lookup_format, cited_regulations, assessment_rows, section_registry)
}
ORACLE_SQL = {
    "collection_roundtrip": BRIDGE + f", k AS (SELECT code, name, rate::DOUBLE AS rate, {KINDS} AS type FROM bench) SELECT * FROM k WHERE type = 'nppa_drug' OR (type = 'cghs_rate' AND code % 2 = 0)",
    "searchable_text": BRIDGE + "SELECT code, CASE type WHEN 'ECONOMY' THEN name || ' Rate: ₹' || format('{:,.2f}', rate::DOUBLE) || ' Speciality: ' || brand WHEN 'SMALL' THEN name || ' - Status: ' || brand ELSE name || ' ' || brand || ' MRP: ₹' || format('{:,.2f}', rate::DOUBLE) END AS text FROM bench",
    "flat_metadata": BRIDGE + f"SELECT code, CASE WHEN code % 2 = 0 THEN 'type,brand' ELSE 'type' END AS keys, {KINDS} || CASE WHEN code % 2 = 0 THEN ',' || brand ELSE '' END AS vals FROM bench",
    "page_text": "WITH ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents), p AS (SELECT doc_id, count(*) AS n_pages, string_agg(x, chr(10) ORDER BY line) AS t FROM ln WHERE line % 4 <> 3 AND trim(x) <> '' GROUP BY doc_id) SELECT doc_id, n_pages, length(t)::BIGINT AS chars, md5(t) AS digest FROM p",
    "issue_sink": ISSUES + "SELECT issue_type, confidence, count(*) AS n, count(CASE WHEN pos % 2 = 1 THEN nullif(overcharge, 0) END) AS n_over, sum(billed)::DOUBLE AS billed FROM iss GROUP BY ALL",
    "result_export": ISSUES + "SELECT bills.bill_id, coalesce(n_issues, 0) AS n_issues, arg_min(description, stage * 1000 + pos) AS first_issue, arg_min(confidence, stage * 1000 + pos) AS first_confidence FROM bills LEFT JOIN agg USING (bill_id) LEFT JOIN dd ON dd.bill_id = bills.bill_id GROUP BY bills.bill_id, n_issues",
    "file_types": "SELECT page_id, ['unknown', 'discharge', 'rejection', 'policy', 'bill', 'unknown'][page_id % 6 + 1] AS file_type FROM pages",
    "column_roles": BRIDGE + "SELECT bill_id AS doc_id, pos AS row, service_date::VARCHAR AS date, description, quantity::INT::VARCHAR AS qty, rate::VARCHAR AS rate, amount::VARCHAR AS amount FROM li",
    "payable_status": "SELECT ['not_payable', 'payable', 'conditionally_payable', 'conditionally_payable', 'review_manually', 'review_manually', 'conditionally_payable'][p_partkey % 7 + 1] AS status, count(*) AS n FROM part GROUP BY ALL",
    "price_tokens": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 7.5 ELSE round(l_extendedprice, 2) END AS price, CASE l_linenumber WHEN 1 THEN 'S.O. 1234(E) 01.04.2023' WHEN 2 THEN 'SO 99 (E)' ELSE 'none' END AS notification FROM lineitem",
    "price_buckets": BRIDGE + "SELECT CASE WHEN amount < 10000 THEN 'small' WHEN amount < 30000 THEN 'middle' WHEN amount < 60000 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS n, max(amount)::DOUBLE AS top FROM li GROUP BY ALL",
    "parse_quality": BRIDGE
    + ", g AS (SELECT bill_id, pos, amount, CASE WHEN code % 4 = 0 THEN '#1|2 %%9 x' WHEN code % 9 = 0 THEN 'ab' ELSE description END AS d FROM li), p AS (SELECT bill_id, bool_or(amount > 0) AS has_amounts, bool_or(length(trim(d)) > 3) AS has_descriptions, count(*) FILTER (pos <= 5 AND d = '#1|2 %%9 x') AS n_garbled FROM g GROUP BY bill_id) SELECT *, has_amounts AND has_descriptions AND n_garbled < 2 AS usable FROM p",
    "consumables": BRIDGE + "SELECT bill_id, pos, amount::DOUBLE AS billed, 'medium' AS confidence FROM li WHERE amount > 10000 AND contains(description, 'gizmo')",
    "lab_overcharge": BRIDGE
    + ", s AS (SELECT *, 40 + code % 40 AS sim, rate * quantity AS ref FROM li WHERE category IN ('LARGE', 'MEDIUM')) SELECT bill_id, pos, CASE WHEN sim >= 45 THEN 'procedure_overcharge' ELSE 'missing_itemization' END AS issue_type, CASE WHEN sim < 45 THEN 'low' WHEN sim >= 65 THEN CASE WHEN amount::DOUBLE / ref::DOUBLE > 5 THEN 'medium' ELSE 'high' END WHEN sim >= 55 THEN 'medium' ELSE 'low' END AS confidence, amount::DOUBLE AS billed, CASE WHEN sim >= 45 THEN ref::DOUBLE END AS benchmark FROM s WHERE sim < 45 OR amount > ref * 1.5",
    "suppress_consults": BRIDGE
    + "SELECT a.bill_id, a.pos, a.description FROM li a WHERE NOT EXISTS (SELECT 1 FROM li b WHERE b.bill_id = a.bill_id AND b.category = a.category AND b.pos < a.pos AND starts_with(b.description, split_part(a.description, ' ', 1)))",
    "repeated_consults": BRIDGE
    + "SELECT a.bill_id, a.pos, a.description FROM li a WHERE NOT EXISTS (SELECT 1 FROM li b WHERE b.bill_id = a.bill_id AND floor(b.amount / 10000) = floor(a.amount / 10000) AND b.pos < a.pos AND starts_with(b.description, split_part(a.description, ' ', 1)))",
    "first_prices": BRIDGE + ", o AS (SELECT * FROM bench QUALIFY row_number() OVER (PARTITION BY name ORDER BY code) = 1) SELECT name, code, rate::DOUBLE AS rate FROM o QUALIFY row_number() OVER (PARTITION BY rate ORDER BY code) = 1",
    "special_match": BRIDGE + ", b AS (SELECT code AS matched, rate AS ceiling FROM bench WHERE name = 'small rod' ORDER BY code LIMIT 1) SELECT bill_id, pos, matched, amount::DOUBLE AS billed, (ceiling * quantity)::DOUBLE AS benchmark FROM li JOIN b ON amount > ceiling * quantity * 1.05 WHERE description LIKE '%rod'",
    "lookup_format": BRIDGE
    + ", t AS (SELECT department, description, amount, row_number() OVER (PARTITION BY department ORDER BY amount DESC, bill_id, pos) AS n FROM li JOIN bills USING (bill_id)) SELECT department, string_agg('[' || n || '] ' || description || ': ₹' || format('{:,.2f}', amount::DOUBLE), chr(10) ORDER BY n) AS text FROM t WHERE n <= 3 GROUP BY department",
    "cited_regulations": "SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(text, 'the') THEN 'Rate schedule' END, CASE WHEN contains(text, 'tion') THEN 'Price orders' END, CASE WHEN contains(text, 'que') THEN 'Master circular' END], lambda x: x IS NOT NULL)), '; ') AS cited FROM documents",
    "assessment_rows": BRIDGE
    + ", s AS (SELECT *, CAST(amount * (1 - discount) AS DECIMAL(18,2)) AS st FROM li) SELECT bill_id AS doc_id, pos AS row, description || ' x' AS description, amount::DOUBLE AS claimed, st::DOUBLE AS settled, (amount - st)::DOUBLE AS disputed, ['PARTIALLY APPROVED', 'REJECTED', 'APPROVED', 'OPEN'][code % 4 + 1] AS status, CASE WHEN code % 2 = 0 THEN 'Clause 4' ELSE 'Clause 5' END AS clause FROM s",
    "section_registry": ISSUES
    + """, d2 AS (SELECT * FROM iss QUALIFY row_number() OVER (PARTITION BY bill_id, trim(regexp_replace(lower(description), '[^a-z0-9_ ]', '', 'g')), billed ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, coalesce(overcharge, 0) DESC, stage, pos) = 1),
p AS (SELECT bill_id, count(*) FILTER (confidence = 'high') AS a, coalesce(sum(overcharge) FILTER (confidence = 'high'), 0) AS t, count(*) FILTER (issue_type = 'drug_overcharge') AS b FROM d2 GROUP BY bill_id)
SELECT bill_id, array_to_string(list_filter([CASE WHEN a > 0 THEN 'Confirmed: ' || a || ' over ' || format('{:,.2f}', t::DOUBLE) END, CASE WHEN b > 0 THEN 'Drugs: ' || b END], lambda x: x IS NOT NULL), chr(10)) AS content FROM p WHERE a > 0 OR b > 0""",
}

"""Queries of stored tables: rows set aside with reasons, versions replaced whole, rows counted while they are written, chunks as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import matching as M
from ..sources import catalog as C
from ..sources import files as S
from ..sources.bridge import BRIDGE, benchmarks, bills, shared_folder, stored, table


def _folder(spark):
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def _analyses(spark, d):
    """Bills as analyses, some of which break the rules of their table."""
    b = bills(spark, d)
    status = F.when(F.col("bill_id") % 5 == 0, F.lit(None)).when(F.col("bill_id") % 7 == 0, "lost").when(F.col("status") == "F", "complete").otherwise("failed")
    total = F.when(F.col("bill_id") % 11 == 0, "n/a").otherwise(F.col("bill_total").cast("string"))
    user = F.when(F.col("patient_id") % 13 != 0, F.col("patient_id").cast("string"))
    return b.select((F.col("bill_id") - F.col("bill_id") % 3).cast("string").alias("id"), user.alias("user_id"), status.alias("status"), total.alias("bill_total"), F.lit("x").alias("extra"), "bill_id")


def catalog_quarantine(spark, d):
    """Every analysis with what is wrong with it, or with nothing; of one id the smallest bill stays."""
    good, bad = C.admitted(_analyses(spark, d), C.TABLES["analyses"], order=("bill_id",))
    shown = lambda df, reasons: df.select("id", "user_id", "status", F.col("bill_total").cast("double").alias("bill_total"), reasons.alias("reasons"))
    return shown(good, F.lit("")).unionByName(shown(bad, F.array_join("reasons", "; ")))


def catalog_children(spark, d):
    """Documents of analyses that were taken, and of others."""
    good, _ = C.admitted(_analyses(spark, d), C.TABLES["analyses"], order=("bill_id",))
    kind = F.element_at(F.array(*map(F.lit, ("bill", "discharge", "rejection", "policy", "photo"))), (F.col("bill_id") % 5 + 1).cast("int"))
    docs = bills(spark, d).select(F.col("bill_id").cast("string").alias("id"), F.col("bill_id").cast("string").alias("analysis_id"), kind.alias("doc_type"), F.concat(F.lit("/"), "bill_id").alias("file_path"))
    taken, bad = C.admitted(docs, C.TABLES["documents"], {"analyses": good})
    why = F.array_join("reasons", "; ")
    return taken.groupBy(F.lit("").alias("reasons")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(why.alias("reasons")).agg(F.count("*").alias("n")))


def full_refresh(spark, d):
    """A table replaced by a version of other rows, as a reader finds it before and after, the first frame read last."""
    path = _folder(spark)
    rows = benchmarks(spark, d).select("code", "name", F.col("rate").cast("double").alias("rate"), "type")
    C.refreshed(rows, path, ("type",))
    before = C.current(spark, path)
    C.refreshed(rows.filter("code % 2 = 0"), path, ("type",))
    shown = lambda df, name: df.groupBy(F.lit(name).alias("version"), "type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("rate").cast("decimal(12,2)")), 2).cast("double").alias("total"))
    return shown(before, "old").unionByName(shown(C.current(spark, path), "new"))


def observed_rows(spark, d):
    """Price rows with a proper code and a price, with the numbers kept and dropped by the same pass that wrote them."""
    rows = benchmarks(spark, d).select("code", "name", F.when(F.col("brand").endswith("1"), None).otherwise(F.col("rate")).alias("price"))
    kept, n = M.kept_while_stored(rows, F.col("price").isNotNull() & (F.col("code") % 3 != 0), lambda df: stored(df, "prices"))
    return kept.agg(F.count("*").alias("n_rows"), F.sum("price").cast("double").alias("total")).select("*", *[F.lit(v).cast("long").alias(k) for k, v in n.items()])


def chunk_json(spark, d):
    """Lines of documents as chunk files by source and back, with their metadata as strings."""
    path = f"{_folder(spark)}/chunks"
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("page", "text")).filter("trim(text) <> '' AND page < 4")
    terms = F.filter(F.array(*[F.when(F.contains(F.col("text"), F.lit(w)), F.lit(w)) for w in ("the", "tion", "que")]), lambda x: x.isNotNull())
    chunks = lines.select(F.concat_ws("-", "doc_id", "page").alias("chunk_id"), "text", F.coalesce("source", F.lit("none")).alias("source"), F.lit(None).cast("string").alias("reference"), F.col("lang").alias("date"), F.lit(4).alias("total_pages"), "page", F.lit("").alias("section"), F.array().cast("array<string>").alias("timelines"), terms.alias("key_terms"))
    S.write_chunks(chunks, path)
    return S.read_chunks(spark, path).select("chunk_id", F.md5("text").alias("digest"), F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("metadata"))


_ANALYSES = BRIDGE + """, a AS (SELECT bill_id, (bill_id - bill_id % 3)::VARCHAR AS id, CASE WHEN patient_id % 13 <> 0 THEN patient_id::VARCHAR END AS user_id, bill_id % 11 = 0 AS odd, bill_total::DOUBLE AS bill_total,
  CASE WHEN bill_id % 5 = 0 THEN 'processing' WHEN bill_id % 7 = 0 THEN 'lost' WHEN status = 'F' THEN 'complete' ELSE 'failed' END AS status FROM bills),
r AS (SELECT *, list_filter([CASE WHEN odd THEN 'bill_total is no decimal(12,2)' END, CASE WHEN user_id IS NULL THEN 'user_id is missing' END, CASE WHEN status = 'lost' THEN 'status is none of the allowed' END], lambda x: x IS NOT NULL) AS why FROM a),
t AS (SELECT *, CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') WHEN row_number() OVER (PARTITION BY id, len(why) = 0 ORDER BY bill_id) > 1 THEN 'id is there already' ELSE '' END AS reasons FROM r)"""

QUERIES = {f.__name__: f for f in (catalog_quarantine, catalog_children, full_refresh, observed_rows, chunk_json)}
ORACLE_SQL = {
    "catalog_quarantine": _ANALYSES + " SELECT id, user_id, status, CASE WHEN NOT odd THEN bill_total END AS bill_total, reasons FROM t",
    "catalog_children": _ANALYSES
    + """, g AS (SELECT DISTINCT id FROM t WHERE reasons = ''), k AS (SELECT concat_ws('; ', CASE WHEN bill_id % 5 = 4 THEN 'doc_type is none of the allowed' END, CASE WHEN bill_id::VARCHAR NOT IN (SELECT id FROM g) THEN 'analysis_id has no row in analyses' END) AS reasons FROM bills)
SELECT reasons, count(*) AS n FROM k GROUP BY reasons""",
    "full_refresh": BRIDGE + "SELECT 'old' AS version, type, count(*) AS n, sum(rate)::DOUBLE AS total FROM bench GROUP BY type UNION ALL SELECT 'new', type, count(*), sum(rate)::DOUBLE FROM bench WHERE code % 2 = 0 GROUP BY type",
    "observed_rows": BRIDGE + "SELECT count(*) FILTER (ok) AS n_rows, (sum(rate) FILTER (ok))::DOUBLE AS total, count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_dropped FROM (SELECT rate, brand NOT LIKE '%1' AND code % 3 <> 0 AS ok FROM bench)",
    "chunk_json": """WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS page FROM documents WHERE text IS NOT NULL)
SELECT doc_id || '-' || page AS chunk_id, md5(text) AS digest, concat_ws('|', 'chunk_chars=' || length(text), 'date=' || lang, CASE WHEN contains(text, 'the') OR contains(text, 'tion') OR contains(text, 'que') THEN 'key_terms=' || concat_ws(', ', CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'tion') THEN 'tion' END, CASE WHEN contains(text, 'que') THEN 'que' END) END, 'page=' || page, 'section=', 'source=' || coalesce(source, 'none')) AS metadata
FROM l WHERE trim(text) <> '' AND page < 4""",
}

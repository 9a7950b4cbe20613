"""Sources and sinks: parsed documents, page texts, uploads, collections, issues, results, and their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUES = T.StructType([T.StructField(n, t) for n, t in (("bill_id", T.LongType()), ("issue_type", T.StringType()), ("description", T.StringType()), ("billed", T.DecimalType(12, 2)), ("benchmark", T.DecimalType(12, 2)), ("overcharge", T.DecimalType(12, 2)), ("confidence", T.StringType()))])
LINE = T.StructType([T.StructField(n, t) for n, t in (("date", T.StringType()), ("description", T.StringType()), ("category", T.StringType()), ("quantity", T.DoubleType()), ("rate", T.DoubleType()), ("amount", T.DoubleType()), ("batch_no", T.StringType()))])
BILL = T.StructType([T.StructField("bill_id", T.StringType()), T.StructField("header", T.MapType(T.StringType(), T.StringType())), T.StructField("line_items", T.ArrayType(LINE)), T.StructField("totals", T.MapType(T.StringType(), T.DoubleType()))])
#: Upload types and the largest size that is read.
SUFFIXES = ("pdf", "png", "jpg", "jpeg")
LARGEST = 10 << 20


def parsed_bills(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bills and their lines (bill_id, pos, ...) from JSON documents; broken ones come out empty."""
    raw = spark.read.schema(BILL).option("multiLine", True).json(path)
    return raw.drop("line_items"), raw.select("bill_id", F.posexplode_outer("line_items").alias("pos", "x")).filter("x IS NOT NULL").select("bill_id", "pos", "x.*")


RESULTS = "query string, answer string, results array<struct<url:string,title:string,content:string,score:double>>"


def search_results(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """query, rank, url, title, content and score of saved searches, best first in each; equal scores by url.  ``whole``: documents over several lines.

    Broken documents and those without results give no row; results without a score come last.
    """
    raw = spark.read.schema(RESULTS).option("multiLine", whole).json(path)
    each = raw.select("query", F.explode("results").alias("r")).select("query", "r.*").filter("url IS NOT NULL")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "url")))


METADATA = {"source": "string", "reference": "string", "date": "string", "page": "int", "section": "string", "timelines": "array<string>", "key_terms": "array<string>", "chunk_chars": "int"}
CHUNKS = "document_info struct<source:string,reference:string,date:string,total_pages:int>, chunking_strategy string, total_chunks int, chunks array<struct<chunk_id:string,text:string,metadata:struct<{}>>>".format(
    ",".join(f"{k}:{t}" for k, t in METADATA.items())
)
STRATEGY = "lines and clauses, packed up to a length"


def write_chunks(chunks: DataFrame, path: str, strategy: str = STRATEGY) -> None:
    """One JSON document for each source of ``chunks`` (chunk_id, text, source, reference, date, total_pages, page, section, timelines, key_terms), a line each."""
    meta = F.struct("source", "reference", "date", F.col("page").cast("int").alias("page"), "section", "timelines", "key_terms", F.length("text").alias("chunk_chars"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk_id", "text", meta.alias("metadata")))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"), x["metadata"].alias("metadata")))
    per = chunks.groupBy("source", "reference", "date").agg(F.max("total_pages").cast("int").alias("total_pages"), F.count("*").cast("int").alias("total_chunks"), listed.alias("chunks"))
    per.select(F.struct("source", "reference", "date", "total_pages").alias("document_info"), F.lit(strategy).alias("chunking_strategy"), "total_chunks", "chunks").write.json(path)


def read_chunks(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """chunk_id, text and metadata as one string each, empty and missing ones left out; ``whole``: documents over several lines.

    Documents that cannot be read have no chunks.
    """
    each = spark.read.schema(CHUNKS).option("multiLine", whole).json(path).select(F.explode("chunks").alias("c")).select("c.chunk_id", "c.text", "c.metadata")
    told = []
    for name, kind in METADATA.items():
        value = F.col("metadata")[name]
        told.append(F.struct(F.lit(name).alias("key"), (F.nullif(F.array_join(value, ", "), F.lit("")) if kind.startswith("array") else value.cast("string")).alias("value")))
    return each.select("chunk_id", "text", F.map_from_entries(F.filter(F.array(*told), lambda x: x["value"].isNotNull())).alias("metadata"))


def page_texts(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Per document the texts of its pages that are not blank, in order, and their number and size."""
    kept = pages.filter(F.trim(text) != "")
    per = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_p"), F.count("*").alias("n_pages"))
    return per.select(key, "n_pages", F.array_join(F.transform("_p", lambda x: x[text]), "\n").alias("full_text")).withColumn("chars", F.length("full_text").cast("long"))


def uploads(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, largest: int = LARGEST) -> DataFrame:
    """path, length, suffix and content of uploaded files of allowed types and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes) & (F.col("length") <= largest)).select("path", "length", "suffix", "content")


def write_collections(df: DataFrame, path: str, partition: str = "type") -> None:
    """Each value of ``partition`` that ``df`` holds replaces its collection; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def collection(spark: SparkSession, path: str, name: str, partition: str = "type") -> DataFrame:
    """One collection; the filter prunes to its folder."""
    return spark.read.parquet(path).filter(F.col(partition) == name)


def stored_issues(issues: DataFrame) -> DataFrame:
    """Issue rows as they are stored: nothing billed is 0, benchmarks and overcharges of 0 are null."""
    cents = lambda c: F.col(c).cast("decimal(12,2)")
    none = F.lit(0).cast("decimal(12,2)")
    return issues.select("bill_id", "issue_type", "description", F.coalesce(cents("billed"), none).alias("billed"), F.nullif(cents("benchmark"), none).alias("benchmark"), F.nullif(cents("overcharge"), none).alias("overcharge"), "confidence")


def nested(analysed: DataFrame, issues: DataFrame, *fields: str) -> DataFrame:
    """bill_id and result, a JSON document of the analysis with its issues in order."""
    per = issues.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("stage", "pos", *fields))).alias("_i"))
    j = analysed.join(per, "bill_id", "left")
    listed = F.transform(F.coalesce("_i", F.array()), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return j.select("bill_id", F.to_json(F.struct("bill_id", "n_issues", "verified", listed.alias("issues"))).alias("result"))


def benchmark_text(kind: Column, name: Column, rate: Column, extra: Column) -> Column:
    """The searchable text of a price row, by its type."""
    price = F.format_number(rate, 2)
    return F.when(kind == "cghs_rate", F.concat_ws(" ", name, F.concat(F.lit("Rate: ₹"), price), F.concat(F.lit("Speciality: "), extra))).when(kind == "non_payable", F.concat(name, F.lit(" - Status: "), extra)).otherwise(F.concat_ws(" ", name, extra, F.concat(F.lit("MRP: ₹"), price)))


def flat_metadata(fields: dict[str, Column]) -> Column:
    """A map of the fields that are neither null nor empty."""
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))


def file_type(name: Column) -> Column:
    """The kind of document that a file name speaks of."""
    low = F.lower(name)
    return F.when(low.rlike("(discharge|summary|dis[-_ ]?sum)"), "discharge").when(low.rlike("(reject|denial|repud|denied)"), "rejection").when(low.rlike("(policy|certificate|cert)"), "policy").when(low.rlike("(bill|invoice|receipt|tax|charges|hospital|lab|pharm)"), "bill").otherwise("unknown")


# Words of column headings, by role, in order.
ROLES = {"date": ("date",), "description": ("description", "particulars", "item", "service", "details"), "qty": ("qty", "quantity", "nos", "units"), "rate": ("rate", "price", "unit cost", "per unit"), "amount": ("amount", "total", "charges", "value")}


def column_role(heading: Column) -> Column:
    low = F.lower(F.trim(heading))
    out = F.lit(None).cast("string")
    for role, words in reversed(ROLES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, role).otherwise(out)
    return out


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, row, col, text) under a heading row 0 as rows with the columns of :data:`ROLES`.

    A window over each document tells its headings to its cells and leaves them in order of rows, so cells are sorted once and shuffled
    once, or not at all if they come dealt by doc_id.
    """
    w = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    role = F.when(F.col("row") == 0, column_role(F.col("text")))
    heads = F.collect_set(F.when(role.isNotNull(), F.struct("col", role.alias("role")))).over(w)
    own = F.transform(F.filter("_heads", lambda h: h["col"] == F.col("col")), lambda h: h["role"])
    told = cells.filter("doc_id IS NOT NULL").withColumn("_heads", heads).filter("row > 0").select("doc_id", "row", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"), own.alias("_roles"))
    return told.filter(F.size("_roles") > 0).groupBy("doc_id", "row").agg(*[F.max(F.when(F.array_contains("_roles", r), F.col("text"))).alias(r) for r in ROLES])


def payable_status(text: Column) -> Column:
    """not_payable, conditionally_payable, payable or review_manually."""
    low = F.lower(text)
    has = lambda *w: F.contains(low, F.lit(w[0])) if len(w) == 1 else F.contains(low, F.lit(w[0])) | has(*w[1:])
    maybe, no = has("essential", "may be considered", "payable as part"), has("not payable", "non-payable")
    first = F.lower(F.split_part(F.trim(text), F.lit(" "), F.lit(1))).startswith("payable")
    return (
        F.when(text.isNull() | (text == ""), "review_manually").when(no & maybe, "conditionally_payable").when(no, "not_payable").when(maybe, "conditionally_payable").when(has("payable") & first, "payable").when(has("payable"), "conditionally_payable").otherwise("review_manually")
    )


def first_price(tokens: Column) -> Column:
    """The first token that looks like a price."""
    clean = F.transform(tokens, lambda t: F.replace(t, F.lit(",")))
    hits = F.filter(clean, lambda t: t.rlike(r"^\d+\.\d{1,3}$"))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1).try_cast("double"))


def notification(text: Column) -> Column:
    """The order number and the date after it; the trimmed text without one."""
    number = F.regexp_extract(text, r"S\.?\s*O\.?\s*\d{1,5}\s*\(E\)", 0)
    date = F.regexp_extract(text, r"S\.?\s*O\.?\s*\d{1,5}\s*\(E\).*?(\d{1,2}\.\d{1,2}\.\d{2,4})", 1)
    return F.when(number == "", F.trim(text)).when(date == "", number).otherwise(F.concat_ws(" ", number, date))


def bucketed(value: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound above the value."""
    out = F.lit(rest)
    for most, name in reversed(bounds):
        out = F.when(value < most, name).otherwise(out)
    return out


def parse_quality(items: DataFrame) -> DataFrame:
    """Per bill whether parsing went well: an amount, a description, and fewer than two garbled ones of the first five."""
    d = F.coalesce("description", F.lit(""))
    letters = F.regexp_replace(d, r"[\p{L} ]", "")
    garbled = (F.col("pos") <= 5) & (F.length(d) > 0) & (F.length(letters) / F.length(d) > 0.4)
    per = items.groupBy("bill_id").agg(F.coalesce(F.bool_or(F.col("amount") > 0), F.lit(False)).alias("has_amounts"), F.bool_or(F.length(F.trim(d)) > 3).alias("has_descriptions"), F.count_if(garbled).alias("n_garbled"))
    return per.withColumn("usable", F.col("has_amounts") & F.col("has_descriptions") & (F.col("n_garbled") < 2))


def assessment_status(text: Column) -> Column:
    """Statuses as they are cut off in cells, made whole."""
    up = F.upper(F.trim(text))
    return F.when(F.contains(up, F.lit("PARTIALLY")) & F.contains(up, F.lit("APPRO")), "PARTIALLY APPROVED").when(up == "REJECTED", up).when(F.contains(up, F.lit("APPROV")), "APPROVED").otherwise(up)


def assessment_clause(text: Column) -> Column:
    """A clause without the letters that bled in from the cell before it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Z]{2,4}(?=lause)", ""), r"^lause", "Clause")


def assessments(rows: DataFrame) -> DataFrame:
    """rows: doc_id, row, description, claimed, settled, status, clause as texts.  Amounts, whole statuses and clauses, and what is disputed."""
    from ..functions.text import amount

    claimed, settled = amount(F.regexp_replace("claimed", r"^[^\d,]+", "")), amount(F.col("settled"))
    out = rows.filter(F.trim("description") != "")
    return out.select(
        "doc_id", "row", F.regexp_replace(F.trim("description"), r"\s+", " ").alias("description"), claimed.cast("double").alias("claimed"), settled.cast("double").alias("settled"),
        (claimed - settled).cast("double").alias("disputed"), assessment_status(F.col("status")).alias("status"), assessment_clause(F.col("clause")).alias("clause"),
    )

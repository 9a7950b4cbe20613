"""Extraction jobs over tables of page text (doc_id, text): bills, claims, discharge summaries, abbreviations, fixtures in JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X

DATE = r"[0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}"
# One pattern for each field; the first group is the value.
BILL_FIELDS = {
    "hospital_name": r"(?m)^([A-Z][A-Z\s&,.'-]{5,})\s*$",
    "bill_number": r"(?i)bill\s*(?:number|no\.?)[:\s]+([A-Z0-9/\-.]+)",
    "bill_date": rf"(?i)bill\s*date[:\s]+({DATE})",
    "patient_name": r"(?im)patient\s*name[:\s]+([A-Z][A-Za-z\s.]+?)(?:\s+Age[/\s]|$)",
    "patient_id": r"(?i)patient\s*id[:\s]+([A-Z0-9\-/]+)",
    "age_sex": r"(?i)age[/\s]*sex[:\s]+([0-9]+\s*(?:Years?|Yrs?)?\s*/\s*(?:Male|Female|M|F))",
    "admission_date": rf"(?i)admission\s*date[:\s]+({DATE})",
    "discharge_date": rf"(?i)discharge\s*date[:\s]+({DATE})",
    "diagnosis": r"(?im)diagnosis[:\s]+([^\n:]+?)(?:\s+Procedure[:\s]|$)",
    "procedure": r"(?im)procedure[:\s]+([^\n:]+?)(?:\s+Consultant[:\s]|$)",
}
TOTALS = {
    "subtotal": r"(?i)sub\s*total[:\s]*(?:Rs\.?|₹)?\s*([\d,]+(?:\.\d{2})?)",
    "gst": r"(?i)GST[^:]*[:\s]*(?:Rs\.?|₹)?\s*([\d,]+(?:\.\d{2})?)",
    "grand_total": r"(?i)grand\s*total[:\s]*(?:Rs\.?|₹)?\s*([\d,]+(?:\.\d{2})?)",
}
CLAIM_FIELDS = {
    "claim_number": r"(?i)claim\s*number[:\s]+([A-Z0-9/\-]+)",
    "policy_number": r"(?i)policy\s*number[:\s]+([A-Z0-9/\-]+)",
    "sum_insured": r"(?i)sum\s*insured[:\s]+(?:Rs\.?|₹)?\s*([0-9,]+)",
    "cashless": r"(?i)cashless[:\s]+(yes|no)",
    "discharge_date": rf"(?i)discharge\s*date[:\s]*({DATE})",
    "date_of_rejection": rf"(?i)date\s*of\s*rejection[:\s]*({DATE})",
    "settlement_mode": r"(?im)settlement\s*mode[:\s]+([^\n]+?)(?:\s{2,}|$)",
}
CLAIM_AMOUNTS = {
    "amount_claimed": r"(?i)total\s*amount\s*claimed[^\n]*?(?:Rs\.?|₹)?\s*([0-9,]+)",
    "amount_settled": r"(?i)amount\s*approved\s*(?:&|and)?\s*settled[^\n]*?(?:Rs\.?|₹)?\s*([0-9,]+)",
    "amount_rejected": r"(?i)amount\s*rejected[^\n]*?(?:Rs\.?|₹)?\s*([0-9,]+)",
}
# Item lines, footers and what is cut from terms.
ITEM = r"^(?:(\d{1,2}/\d{1,2}/\d{2,4})\s+)?(.+?)\s+(\d+)\s+([\d,]+(?:\.\d{2})?)\s+([\d,]+(?:\.\d{2})?)\s*$"
FOOTER = r"(?i)subtotal|gst|total|grand"
#: A short default of the dictionary of abbreviations, which is a parameter.
ABBREVIATIONS = {
    "cbc": ["complete blood count", "haemogram"],
    "platelet count": ["thrombocyte"],
    "hb": ["hemoglobin", "haemoglobin"],
    "esr": ["erythrocyte sedimentation rate"],
    "lft": ["liver function test"],
    "kft": ["kidney function test"],
    "mri": ["magnetic resonance imaging"],
    "ct": ["computed tomography"],
    "na/k": ["sodium potassium"],
}
ARTIFACTS = (r"\(.*?\)", r"(?i)\s*-\s*dr\..*", r"\s*\d+$", r"\s*-\s*\d+$")


def field(text: Column, pattern: str) -> Column:
    """The trimmed first group, or null; the text is searched once for it."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1), F.lit(" \t\n\r")), F.lit(""))


def bills(pages: DataFrame) -> DataFrame:
    """doc_id, header fields, age and sex, and footer totals."""
    t = F.col("text")
    out = pages.select("doc_id", *[field(t, p).alias(k) for k, p in BILL_FIELDS.items()], *[X.amount(field(t, p)).cast("double").alias(k) for k, p in TOTALS.items()])
    sex = F.upper(F.regexp_extract("age_sex", r"(?i)(Male|Female|M|F)\b", 1))
    return out.withColumn("age", F.regexp_extract("age_sex", r"(\d+)", 1).try_cast("int")).withColumn("sex", F.when(sex.startswith("M"), "Male").when(sex.startswith("F"), "Female")).drop("age_sex")


def bill_items(pages: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, pos, date, description, quantity, rate and amount of the lines that look like items."""
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    part = lambda i: F.regexp_extract("line", ITEM, i)
    hit = lines.filter((F.length("line") >= least) & F.col("line").rlike(ITEM) & ~part(2).rlike(FOOTER))
    return hit.select("doc_id", "pos", F.nullif(part(1), F.lit("")).alias("date"), F.trim(part(2)).alias("description"), part(3).try_cast("int").alias("quantity"), X.amount(part(4)).cast("double").alias("rate"), X.amount(part(5)).cast("double").alias("amount"))


def claims(pages: DataFrame, limit_days: int = 15) -> DataFrame:
    """doc_id, claim fields, amounts, days from discharge to rejection, and whether that is too long (null if unknown)."""
    t = F.col("text")
    found = pages.select("doc_id", *[field(t, p).alias(k) for k, p in (CLAIM_FIELDS | CLAIM_AMOUNTS).items()])
    out = found.withColumns({k: F.when(F.col(k).isNotNull(), X.amount(F.col(k)).cast("double")) for k in CLAIM_AMOUNTS})
    days = X.days_between(F.col("discharge_date"), F.col("date_of_rejection"))
    return out.withColumn("sum_insured", X.digits(F.col("sum_insured"))).withColumn("cashless", F.lower("cashless") == "yes").withColumn("days", days).withColumn("late", F.col("days") > limit_days)


def discharges(pages: DataFrame) -> DataFrame:
    """doc_id, length of stay, wards with their days, and numbered procedures."""
    t = F.col("text")
    wards = field(t, r"(?im)wards?\s*\(?s?\)?[:\s]+([^\n]+?)(?:\s{2,}|$)")
    ward = r"([A-Za-z][A-Za-z\s]+?)\s*\(\s*(\d+)\s*(?:d|days?)\s*\)"
    zipped = F.arrays_zip(F.regexp_extract_all(wards, F.lit(ward), F.lit(1)).alias("type"), F.regexp_extract_all(wards, F.lit(ward), F.lit(2)).alias("days"))
    shaped = F.transform(zipped, lambda x: F.struct(F.trim(x["type"]).alias("type"), x["days"].cast("int").alias("days")))
    procedures = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^\s*\d+\.\s+([^\n]+)"), F.lit(1)), lambda x: F.trim(x))
    stay = F.regexp_extract(t, r"(?i)length\s*of\s*stay[:\s]+([0-9]+)", 1).try_cast("int")
    return pages.select("doc_id", stay.alias("stay_days"), shaped.alias("wards"), procedures.alias("procedures"))


def cleaned(term: Column) -> Column:
    """Lower case, artefacts off, blanks made one."""
    clean = F.lower(F.trim(term))
    for p in ARTIFACTS:
        clean = F.regexp_replace(clean, p, " ")
    return F.trim(F.regexp_replace(clean, r"\s+", " "))


class Expander:
    """Finds the entries of a dictionary in a text by one automaton; ``entries``: (key, expansions) in order of their turn."""

    def __init__(self, entries: list[tuple[str, list[str]]]) -> None:
        import ahocorasick

        self.entries = sorted(entries, key=lambda e: -len(e[0]))  # stable: equal lengths keep their order
        self.exact = {k: i for i, (k, _) in reversed(list(enumerate(self.entries)))}
        self.automaton = ahocorasick.Automaton()
        for k, i in self.exact.items():
            self.automaton.add_word(k, i)
        if self.exact:
            self.automaton.make_automaton()
        self.patterns: dict[int, re.Pattern] = {}

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.patterns:
            self.patterns[i] = re.compile(rf"\b{re.escape(self.entries[i][0])}\b", re.ASCII)
        return self.patterns[i]

    def __call__(self, text: str) -> list[int]:
        """The entries that a cleaned text stands for: itself, or else what it holds as words, longest first and each part used up once."""
        if text in self.exact:
            return [self.exact[text]]
        out: list[int] = []
        while self.exact:
            # what is left is searched again, for parts that are taken out may bring others together
            turn = {i for _, i in self.automaton.iter(text) if i > (out[-1] if out else -1)}
            found = next((i for i in sorted(turn) if self.pattern(i).search(text)), None)
            if found is None:
                break
            out.append(found)
            text = self.pattern(found).sub("", text)
        return out


def expanded_by(terms: DataFrame, dictionary: DataFrame, most: int = 100_000) -> DataFrame:
    """term, cleaned, expanded, matched and n_expansions of each different term, by a table of entries (abbreviation, expansions, place).

    Of equal abbreviations the first place counts.  The dictionary is counted and sent to the workers; more than ``most``
    entries are an error.  A null term is left as it is; empty abbreviations and nulls are no entries.
    """
    fine = dictionary.filter("abbreviation <> '' AND expansions IS NOT NULL").select(F.lower("abbreviation").alias("abbreviation"), "expansions", "place")
    rows = fine.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has more than {most} entries")
    entries = [(r.abbreviation, list(r.expansions)) for r in sorted(rows, key=lambda r: (r.place, r.abbreviation, r.expansions))]
    sent = terms.sparkSession.sparkContext.broadcast(entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = Expander(sent.value)
        for batch in batches:
            found = [expand(t or "") for t in batch.column("cleaned").to_pylist()]
            words = [list(dict.fromkeys(w for i in x for w in expand.entries[i][1])) for x in found]
            whole = [t if t is None else " ".join([t.strip(" "), *w]).strip(" ") for t, w in zip(batch.column("term").to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("term"), batch.column("cleaned"), pa.array(whole, pa.string()), pa.array([[expand.entries[i][0] for i in x] for x in found], pa.list_(pa.string())), pa.array([len(w) for w in words], pa.int32())],
                names=["term", "cleaned", "expanded", "matched", "n_expansions"],
            )

    asked = terms.select("term").distinct().select("term", F.coalesce(cleaned(F.col("term")), F.lit("")).alias("cleaned"))
    return asked.mapInArrow(work, "term string, cleaned string, expanded string, matched array<string>, n_expansions int")


def expanded(terms: DataFrame, dictionary: dict[str, list[str]] = ABBREVIATIONS) -> DataFrame:
    """term and its expansion: artefacts off, an exact entry, or else all entries that it holds as words, longest first and each text used up once.

    Works on distinct terms; the dictionary is a fixed list.
    """
    clean = cleaned(F.col("term"))
    entries = sorted(dictionary.items(), key=lambda e: -len(e[0]))  # stable: equal lengths keep their order
    exact = F.coalesce(*[F.when(clean == k, F.array(*map(F.lit, v))) for k, v in entries])
    listed = F.array(*[F.struct(F.lit(rf"\b\Q{k}\E\b").alias("p"), F.array(*map(F.lit, v)).alias("v")) for k, v in entries])
    held = F.filter(listed, lambda e: F.regexp_like(F.col("_clean"), e["p"]))
    folded = F.aggregate(
        held,
        F.struct(F.col("_clean").alias("rest"), F.array().cast("array<string>").alias("out")),
        lambda a, e: F.when(F.regexp_like(a["rest"], e["p"]), F.struct(F.regexp_replace(a["rest"], e["p"], F.lit("")).alias("rest"), F.concat(a["out"], e["v"]).alias("out"))).otherwise(a),
    )["out"]
    words = F.array_distinct(F.coalesce(F.col("_exact"), folded))
    return terms.select("term").distinct().select("term", clean.alias("_clean"), exact.alias("_exact")).select("term", F.trim(F.concat_ws(" ", F.trim("term"), F.array_join(words, " "))).alias("expanded"))


def anchored(cells: DataFrame, is_anchor: Column, key: str, order: str, column: str, text: str, columns: list[str]) -> DataFrame:
    """Spans from one anchor cell to the next, the texts of each column joined in order: one row per span."""
    number = F.sum(is_anchor.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    def joined(name: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col(column) == name, F.struct(order, text))))
        return F.nullif(F.array_join(F.transform(own, lambda x: x[text]), " "), F.lit("")).alias(name)

    return cells.withColumn("entry", number).filter("entry > 0").groupBy(key, "entry").agg(*map(joined, columns))


def price_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a price JSON file, whichever of its lists holds them."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [F.col(c) for c in ("entries", "rates", "drugs", "items", "results") if c in raw.columns]
    return raw.select(F.explode(F.coalesce(*lists)).alias("x")).select("x.*") if lists else raw


def rules_or(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """A rule file, or the default where it is missing or broken."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return default
    return default if "_corrupt_record" in found.columns or not set(default.columns) <= set(found.columns) else found.select(default.columns)

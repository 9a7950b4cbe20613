"""Fields of claim letters, insurers, grievance contacts, patients, diagnoses, procedures, medications and narratives, from page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import BILL_FIELDS, DATE, field

# One pattern for each field; the first group is the value.
CLAIM_FIELDS = {
    "claim_number": r"(?im)claim\s*number[:\s]+([A-Z0-9/\-]+)",
    "policy_number": r"(?im)policy\s*number[:\s]+([A-Z0-9/\-]+)",
    "policy_holder": r"(?im)policy\s*holder[:\s]+([A-Z][A-Za-z\s.]+?)(?:\s{2,}|$|insured|sum)",
    "insured_name": r"(?im)insured\s*name[:\s]+([A-Z][A-Za-z\s.]+?)(?:\s{2,}|$|sum|hospital)",
    "hospital": r"(?im)hospital[:\s]+([^\n]+?)(?:\s{2,}|cashless|admission|$)",
    "admission_date": rf"(?im)admission\s*date[:\s]*({DATE})",
    "discharge_date": rf"(?im)discharge\s*date[:\s]*({DATE})",
    "pre_auth_date": rf"(?im)pre-?auth\s*date[:\s]*({DATE})",
    "pre_auth_status": r"(?im)pre-?auth\s*status[:\s]+([^\n]+?)(?:\s{2,}|date|$)",
    "date_of_rejection": rf"(?im)date\s*of\s*rejection[:\s]*({DATE})",
    "date_of_letter": rf"(?im)date\s*of\s*letter[:\s]*({DATE})",
}
REGISTRATION = r"(?i)IRDAI\s*Registration\s*(?:No\.?|Number)?[:\s]+([0-9]+)"
INSURER_WORDS = ("INSURANCE", "HEALTH", "GENERAL")
CONTACT_FIELDS = {
    "officer_name": r"(?i)Grievance\s*Officer[:\s]+(?:Mr\.|Ms\.|Mrs\.)?\s*([A-Z][A-Za-z\s.]+?)(?:\s{2,}|email|phone|$)",
    "officer_email": r"(?i)email[:\s]+([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})",
    "officer_phone": r"(?i)phone[:\s]+(\+?[0-9\-\s]+)(?:\s{2,}|address|$)",
}
PATIENT_FIELDS = {
    "name": r"(?im)patient\s*name[:\s]+([A-Z][A-Za-z\s.]+?)(?:\s{2,}|age|sex|$)",
    "age_sex": r"(?im)age\s*/?\s*sex[:\s]+([0-9]+\s*(?:Years?|Yrs?)?\s*/?\s*(?:Male|Female|M|F))",
    "mrn": r"(?im)MRN\s*/?\s*Patient\s*ID[:\s]+([A-Z]{2,}[\-/][A-Z0-9\-/]+)",
    "bill_number": r"(?im)bill\s*number[:\s]+([A-Z0-9\-/]+)",
    "admission_date": rf"(?im)admission\s*date[:\s]*({DATE})",
    "discharge_date": rf"(?im)discharge\s*date[:\s]*({DATE})",
    "consultant": r"(?im)consultant[:\s]+([^\n]+?)(?:\s{2,}|$|attending)",
    "attending_surgeon": r"(?im)attending\s*surgeon[:\s]+([^\n]+?)(?:\s{2,}|$)",
}
BILL_EXTRAS = {
    "ward_type": r"(?im)ward\s*type[:\s]+([A-Za-z\s()]+?)(?:\s+Discharge|$)",
    "consultant": r"(?im)consultant[:\s]+([^\n:]+?)(?:\s+Insurance[:\s]|$)",
    "insurance": r"(?im)insurance[:\s]+([^\n]+?)(?:\s+CITY|$)",
}
HOSPITAL_LINE = r"(?i)\b(hospital|clinic|healthcare|medical center)\b"
SECTIONS = {
    "diagnosis": r"(?is)FINAL\s*DIAGNOSIS\s*(.+?)(?=PROCEDURES?\s*PERFORMED|CLINICAL\s*COURSE|HOSPITAL\s*STAY|\z)",
    "procedures": r"(?is)PROCEDURES?\s*PERFORMED\s*(.+?)(?=CLINICAL\s*COURSE|HOSPITAL\s*STAY|DISCHARGE\s*MEDICATIONS|\z)",
    "medications": r"(?is)DISCHARGE\s*MEDICATIONS\s*(.+?)(?=CONDITION\s*AT\s*DISCHARGE|FOLLOW-?UP|\z)",
}
NARRATIVES = {
    "clinical_course": r"(?is)CLINICAL\s*COURSE\s*/?\s*HOSPITAL\s*STAY\s*(.+?)(?=DISCHARGE\s*MEDICATIONS|CONDITION\s*AT\s*DISCHARGE|FOLLOW-?UP|\z)",
    "condition_at_discharge": r"(?is)CONDITION\s*AT\s*DISCHARGE\s*(.+?)(?=FOLLOW-?UP|\z)",
    "follow_up": r"(?is)FOLLOW-?UP\s*INSTRUCTIONS\s*(.+?)(?=_{3,}|\z)",
}
CODE = r"([A-Z]?\d{1,3}(?:\.\d{1,3})?)"
PRIMARY = r"(?is)Primary[:\s]+(.+?)(?:\s*ICD-?10[:\s]*[A-Z]?\d{1,3}(?:\.\d{1,3})?)?\s*(?:Secondary|\z)"
PRIMARY_CODE = rf"(?is)Primary[^.]*?ICD-?10[:\s]*{CODE}"
SECONDARY = rf"[•\-*]?\s*([A-Z][^•\n(]+?)(?:\s*\(ICD-?10[:\s]*{CODE}\))?(?=\s*[•\-*\n]|\z)"
DRUG = r"(?s)(\d+)\.\s+([A-Z][A-Za-z.]*\.?\s*[A-Z][A-Za-z\s\-]+?\s*\d+\s*(?:mg|g|ml|mcg|IU|units?))\s+(.+?)(?=\n\s*\d+\.|\z)"
DURATION = r"(?i)\s+(Lifelong|Continue|\d+\s*(?:month|week|day|year)s?|Review.*$|As needed.*$)\s*$"
CITATIONS = {
    "rates": r"(?i)CGHS\s+(?:rate|code|entry)\s*[:\-]?\s*(\d+[\d.\-]*)",
    "ceilings": r"(?i)NPPA\s+(?:ceiling|price|rate)\s*[:\-]?\s*₹?\s*(\d+)",
    "regulations": r"(?i)IRDAI\s+(?:guideline|regulation|circular)\s*[:\-]?\s*([A-Z0-9\-/]+)",
}
STATUS_WORDS = ("Not Payable", "Not payable", "Non Payable", "Payable", "Essential")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fields(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [field(text, p).alias(k) for k, p in patterns.items()]


def insurer(text: Column) -> Column:
    """The first of the first five lines that is in capitals and holds an insurer's word."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), F.trim)
    fit = lambda x: (F.length(x) > 10) & (F.upper(x) == x) & (F.lower(x) != x) & x.rlike("|".join(INSURER_WORDS))
    return F.get(F.filter(lines, fit), 0)


def hospital(text: Column, found: Column, lines: int = 10) -> Column:
    """The name found before, or else the first of the first lines that speaks of a hospital."""
    hit = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, lines), F.trim), lambda x: (F.length(x) > 5) & x.rlike(HOSPITAL_LINE))
    return F.coalesce(found, one_line(F.get(hit, 0)))


def headers(pages: DataFrame) -> DataFrame:
    """doc_id, hospital_name (by its pattern, or else the first line that speaks of one), ward_type, consultant and insurance; of two the first counts."""
    t = F.coalesce("text", F.lit(""))
    return pages.select("doc_id", hospital(t, field(t, BILL_FIELDS["hospital_name"])).alias("hospital_name"), *fields(t, BILL_EXTRAS))


def primary(text: Column) -> tuple[Column, Column]:
    """The primary diagnosis and its code.

    A primary diagnosis without a code takes the first code of the section, even one that stands with a secondary diagnosis.
    """
    part = field(text, SECTIONS["diagnosis"])
    name = F.rtrim(one_line(F.regexp_replace(field(part, PRIMARY), r"(?i)\s*ICD-?10.*$", "")), F.lit("."))
    return name, F.when(name.isNotNull(), field(part, PRIMARY_CODE))


def secondary(text: Column) -> Column:
    """array<struct<diagnosis, icd10>> of the secondary diagnoses."""
    part = F.regexp_extract(field(text, SECTIONS["diagnosis"]), r"(?is)Secondary[:\s]*(.+?)\z", 1)
    both = F.arrays_zip(F.regexp_extract_all(part, F.lit(SECONDARY), F.lit(1)).alias("d"), F.regexp_extract_all(part, F.lit(SECONDARY), F.lit(2)).alias("c"))
    named = F.transform(both, lambda x: F.struct(one_line(F.rtrim(F.trim(x["d"]), F.lit(",.;"))).alias("diagnosis"), F.nullif(x["c"], F.lit("")).alias("icd10")))
    return F.filter(named, lambda x: (F.length(x["diagnosis"]) >= 5) & ~F.lower(x["diagnosis"]).isin("icd", "icd-10"))


def procedures(text: Column) -> Column:
    """array<struct<name, date, performed_by, notes>> of the numbered procedures."""
    blocks = F.split(field(text, SECTIONS["procedures"]), r"(?:^|\s)\d+\.\s+")

    def shaped(b: Column) -> Column:
        name = F.rtrim(one_line(F.regexp_extract(b, r"^([^\n]+?)(?:\s*Date:|\s*\n|\z)", 1)), F.lit("."))
        rest = b
        for p in (r"(?i)Date[:\s]+[0-9/\-]+\s*\|?\s*Performed\s*by[:\s]+[^\n]+\n?", r"(?i)Date[:\s]+[0-9/\-]+\n?", r"(?i)Performed\s*by[:\s]+[^\n]+\n?"):
            rest = F.regexp_replace(rest, p, "")
        at = F.position(name, rest)
        rest = F.when(at > 0, F.concat(F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + F.length(name)))).otherwise(rest)
        return F.struct(
            name.alias("name"),
            F.nullif(F.regexp_extract(b, rf"Date[:\s]+({DATE})", 1), F.lit("")).alias("date"),
            F.nullif(F.trim(F.regexp_extract(b, r"Performed\s*by[:\s]+([^\n|]+?)(?:\s{2,}|\n|\z|\|)", 1)), F.lit("")).alias("performed_by"),
            F.nullif(F.rtrim(one_line(rest), F.lit(".")), F.lit("")).alias("notes"),
        )

    return F.filter(F.transform(F.slice(blocks, 2, 1 << 20), shaped), lambda x: x["name"] != "")


def medications(text: Column) -> Column:
    """array<struct<drug, frequency, duration>> of the numbered medications."""
    part = field(text, SECTIONS["medications"])
    both = F.arrays_zip(F.regexp_extract_all(part, F.lit(DRUG), F.lit(2)).alias("d"), F.regexp_extract_all(part, F.lit(DRUG), F.lit(3)).alias("r"))

    def shaped(x: Column) -> Column:
        rest = one_line(x["r"])
        duration = F.nullif(F.trim(F.regexp_extract(rest, DURATION, 1)), F.lit(""))
        often = F.when(duration.isNull(), rest).otherwise(F.rtrim(F.trim(F.regexp_replace(rest, DURATION, "")), F.lit(",")))
        return F.struct(F.trim(x["d"]).alias("drug"), often.alias("frequency"), duration.alias("duration"))

    return F.transform(both, shaped)


def narratives(text: Column) -> Column:
    """map of the narrative sections that the text has."""
    each = F.map_from_arrays(F.array(*map(F.lit, NARRATIVES)), F.array(*[one_line(field(text, p)) for p in NARRATIVES.values()]))
    return F.map_filter(each, lambda _, v: v.isNotNull())


def citations(text: Column) -> Column:
    """struct of what the text cites of rates, ceilings and regulations."""
    return F.struct(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias(k) for k, p in CITATIONS.items()])


def name_and_status(line: Column, words: tuple[str, ...] = STATUS_WORDS) -> Column:
    """struct of name and status: cut before the first listed word that stands after the start, or else at the first wide gap."""
    gap = F.split(line, r"\s{2,}", 2)
    out = F.struct(F.trim(F.get(gap, 0)).alias("name"), F.coalesce(F.trim(F.get(gap, 1)), F.lit("")).alias("status"))
    for w in reversed(words):
        at = F.instr(line, w)
        out = F.when(at > 1, F.struct(F.trim(F.substr(line, F.lit(1), at - 1)).alias("name"), F.trim(F.substr(line, at)).alias("status"))).otherwise(out)
    return out


def first_of(*columns: Column | str) -> Column:
    """The first of several names of a field that has a value: not null, not empty, not zero."""
    return F.coalesce(*[F.when((F.col(c) if isinstance(c, str) else c).cast("string").isin("", "0", "0.0", "0.00"), None).otherwise(F.col(c) if isinstance(c, str) else c) for c in columns])

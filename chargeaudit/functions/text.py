"""Column functions on text: amounts, quantities, redaction, filters, mentions, headings, clauses."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

MONEY = "decimal(18,2)"
# What is redacted, in order, and what is filtered.
PII = (
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "XXXX-XXXX-XXXX"),
    (r"\b[A-Z]{5}\d{4}[A-Z]\b", "XXXXX1234X"),
    (r"\b[6-9]\d{9}\b", "XXXXXXXXXX"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "user@redacted.com"),
)
INJECTIONS = (
    r"ignore\s+(all\s+)?(previous\s+)?(instructions|prompts|rules)",
    r"disregard\s+(all\s+)?(previous\s+)?(instructions|prompts|rules)",
    r"override\s+system",
    r"system\s*:\s*",
    r"assistant\s*:\s*",
    r"you\s+are\s+now",
    r"forget\s+(everything|all)",
    r"new\s+instructions",
    r"admin\s+mode",
    r"developer\s+mode",
    r"sudo\s+mode",
)
PROMPT_INJECTIONS = (
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(the\s+)?(system\s+)?prompt",
    r"you\s+are\s+now\s+(in\s+)?dan\s+mode",
    r"pretend\s+(you\s+are|to\s+be)",
    r"act\s+as\s+if",
    r"bypass\s+(your\s+)?guidelines",
    r"override\s+(your\s+)?instructions",
    r"jailbreak",
    r"developer\s+mode",
    r"god\s+mode",
    r"simulate\s+(being|a)\s+different",
    r"forget\s+(everything|all\s+previous)",
    r"new\s+instructions?:",
)
# Patterns of time limits, money limits and headings.
TIMELINES = (r"(?i)\b\d+\s*(?:hour|hours|day|days|week|weeks|month|months)\b", r"(?i)\b(?:immediately|forthwith|without delay)\b")
LIMITS = (r"(?i)₹\s*[\d,]+(?:\.\d+)?(?:\s*(?:lakh|lakhs|crore|crores))?", r"(?i)Rs\.?\s*[\d,]+(?:\.\d+)?(?:\s*(?:lakh|lakhs|crore|crores))?")
HEADINGS = (r"^[A-Z][A-Z\s]{10,}$", r"^\d+\.\s+[A-Z]", r"^CHAPTER\s+[A-Z\d]+", r"^PART\s+[A-Z\d]+")
MASKED = "[FILTERED]"


def amount(text: Column) -> Column:
    """Money from strings such as ``Rs. 1,23,456.50/-``; what is no number is 0.  Signs are dropped."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[₹,/\-\s]|Rs\.?", ""), r"\.+$", "")
    return F.coalesce(clean.try_cast(MONEY), F.lit(0).cast(MONEY))


def signed_amount(text: Column) -> Column:
    """Money with its sign; null for what is no number."""
    return F.regexp_replace(text, r"[₹,\s]|Rs\.?|/-", "").try_cast(MONEY)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("bigint")


def quantity(text: Column) -> Column:
    """The first number in the text; 1 without one."""
    return F.coalesce(F.regexp_extract(text, r"\d+\.?\d*", 0).try_cast("double"), F.lit(1.0))


def replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def redacted(text: Column, pairs: Iterable[tuple[str, str]] = PII) -> Column:
    return replaced(text, pairs)


def filtered(text: Column, patterns: Iterable[str] = INJECTIONS) -> Column:
    return replaced(text, [(f"(?i){p}", "[FILTERED]") for p in patterns])


def mentions(text: Column, patterns: Iterable[str]) -> Column:
    """All different matches, pattern by pattern, each kept once at its first place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def terms(text: Column, listed: Iterable[str] = rules.KEY_TERMS) -> Column:
    """The listed terms that the text holds, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, listed)), lambda t: F.contains(low, t))


def heading(line: Column, patterns: Iterable[str] = HEADINGS) -> Column:
    """The trimmed line if it looks like a heading, else null."""
    clean = F.trim(line)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | clean.rlike(p)
    return F.when(hit, clean)


def first_heading(text: Column, lines: int = 5, patterns: Iterable[str] = HEADINGS) -> Column:
    patterns = tuple(patterns)
    hits = F.filter(F.slice(F.split(text, "\n"), 1, lines), lambda x: heading(x, patterns).isNotNull())
    return F.when(F.size(hits) > 0, F.trim(F.element_at(hits, 1)))


def packed(parts: Column, limit: int, glue: str = "\n") -> Column:
    """Consecutive parts joined while they fit into ``limit`` characters; a longer part stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    step = lambda a, x: (
        F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), x.alias("open")))
        .when(F.length(a["open"]) + len(glue) + F.length(x) <= limit, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(glue), x).alias("open")))
        .otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), x.alias("open")))
    )
    return F.aggregate(parts, start, step, lambda a: F.array_compact(F.array_append(a["done"], a["open"])))


def clauses(text: Column, least: int = 50) -> Column:
    """Numbered clauses of some length: struct of number and text."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\d+\.[^\n]*"), F.lit(0))
    return F.filter(found, lambda c: F.length(c) > least)


def days_between(early: Column, late: Column, formats: Iterable[str] = ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy")) -> Column:
    """Days between two date strings that one and the same format reads; null if none does.

    A format of numbers is tried on strings that end in a year of its length, after its separators, for failed tries are slow.
    """
    read = lambda text, f: F.when(text.rlike(shape(f)), F.try_to_timestamp(text, F.lit(f)).cast("date"))
    return F.coalesce(*[F.date_diff(read(late, f), read(early, f)) for f in formats])


def shape(form: str) -> str:
    """A pattern that all strings match which the format reads; for formats other than day, month and year in numbers any string does."""
    m = re.fullmatch(r"dd?([/\-. ])MM?([/\-. ])(yy|yyyy)", form)
    return f"{re.escape(m[1])}.*{re.escape(m[2])}{'.*[0-9]{4}' if m[3] == 'yyyy' else '[0-9]{2}'}$" if m else ""


def json_part(text: Column) -> Column:
    """From the first brace to the last, code fences aside; null without braces."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)

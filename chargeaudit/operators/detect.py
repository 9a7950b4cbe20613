"""Detectors: line items and benchmarks in, issue rows out.

All issue rows have the columns of :data:`ISSUE`.  Money is exact decimals; results cast it to double last.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.predicates import any_keyword

ISSUE = ("bill_id", "pos", "issue_type", "description", "billed", "benchmark", "overcharge", "confidence")


def num(x: str | int) -> Column:
    return F.lit(Decimal(x))


def issues(df: DataFrame, kind: str | Column, billed: Column, benchmark: Column, confidence: str | Column, description: Column | None = None, *more: str) -> DataFrame:
    """Rows of :data:`ISSUE`; the overcharge is what is billed above the benchmark."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    d = lambda x: x.cast("double")
    return df.select(
        "bill_id", "pos", lit(kind).alias("issue_type"), (description if description is not None else F.col("description")).alias("description"),
        d(billed).alias("billed"), d(benchmark).alias("benchmark"), d(billed - benchmark).alias("overcharge"), lit(confidence).alias("confidence"), *more,
    )


def code_match(items: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Lines with the benchmark of their code; others stay with nulls."""
    b = benchmarks.select(F.col("code").alias("_code"), F.col("name").alias("matched"), F.col("rate").alias("bench_rate"))
    return items.join(b, items["code"] == b["_code"], "left").drop("_code")


def similarity_ladder(similarity: Column, steps=((Decimal("0.75"), "high", Decimal("1.5")), (Decimal("0.65"), "medium", Decimal("2.0")))) -> tuple[Column, Column]:
    """Confidence and the multiple of the rate that is tolerated at a similarity; nulls below all steps."""
    level, factor = F.lit(None).cast("string"), F.lit(None).cast("decimal(4,2)")
    for least, name, times in reversed(steps):
        level, factor = F.when(similarity >= least, name).otherwise(level), F.when(similarity >= least, times).otherwise(factor)
    return level, factor


def procedure_overcharge(matched: DataFrame) -> DataFrame:
    """matched: lines with bench_amount and similarity.  High and medium matches above their tolerance, and review issues for the rest."""
    level, factor = similarity_ladder(F.col("similarity"))
    kept = matched.select("*", level.alias("_level"), factor.alias("_factor")).filter(F.col("_level").isNull() | (F.col("amount") > F.col("bench_amount") * F.col("_factor")))
    sure = F.col("_level").isNotNull()
    return issues(
        kept,
        F.when(sure, "procedure_overcharge").otherwise("missing_itemization"),
        F.col("amount"),
        F.when(sure, F.col("bench_amount")),
        F.coalesce("_level", F.lit("low")),
    )


def above(items: DataFrame, reference: Column, tolerance: str, kind: str, confidence: str | Column = "high") -> DataFrame:
    """Lines whose amount is more than ``tolerance`` times a reference amount."""
    return issues(items.filter(F.col("amount") > reference * num(tolerance)), kind, F.col("amount"), reference, confidence)


def mrp_violation(items: DataFrame, tolerance: str = "1.02") -> DataFrame:
    """Amounts above price times quantity, by more than the tolerance."""
    return above(items.filter("rate > 0 AND quantity > 0"), F.col("rate") * F.col("quantity"), tolerance, "drug_overcharge")


def arithmetic_errors(items: DataFrame, share: str = "0.05", least: str = "1") -> DataFrame:
    """Lines whose quantity times rate differs from the amount by more than 5 % of it and more than one unit."""
    expected = F.col("quantity") * F.col("rate")
    wrong = F.abs(F.col("amount") - expected) > F.greatest(F.abs(expected) * num(share), num(least).cast("decimal(31,8)"))
    return issues(items.filter(wrong & (expected > 0)), "duplicate_billing", F.col("amount"), expected, "medium")


def duplicate_lines(items: DataFrame) -> DataFrame:
    """Each line whose description and batch an earlier line of the bill has, with that first line."""
    w = Window.partitionBy("bill_id", F.lower(F.trim("description")), F.coalesce("batch_no", F.lit(""))).orderBy("pos")
    first = items.select("*", F.row_number().over(w).alias("_turn"), F.first("pos").over(w).alias("first_pos"), F.first("amount").over(w).alias("first_amount"))
    return first.filter("_turn > 1").select("bill_id", "pos", "first_pos", "description", "batch_no", F.col("amount").cast("double").alias("billed"), F.col("first_amount").cast("double").alias("first_billed"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order."""
    return df.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_turn")).filter("_turn = 1").drop("_turn")


def unrepeated(items: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Lines of which no earlier one of the same keys has a text that begins with their first word.

    A text begins with a word if its first word does, so each line is kept by the first place of the first words that
    begin with its own; those of a key are a short list of different words.
    """
    first = F.split_part("description", F.lit(" "), F.lit(1))
    places = items.groupBy(*keys, first.alias("_first")).agg(F.min(order).alias("_place"))
    per = places.groupBy(*keys).agg(F.collect_list(F.struct("_first", "_place")).alias("_places"))
    joined = items.join(per.hint("merge"), keys)
    earlier = F.exists("_places", lambda x: x["_first"].startswith(first) & (x["_place"] < F.col(order)))
    return joined.filter(~earlier).select(*items.columns)


def bill_sums(items: DataFrame) -> DataFrame:
    return items.groupBy("bill_id").agg(F.sum("amount").alias("line_sum"), F.count("*").alias("n_lines"))


def reconciled(bills: DataFrame, items: DataFrame, tax_rate: str = "0.05") -> DataFrame:
    """Per bill: whether its total is the sum of lines and tax, within one unit; null without a total."""
    tax = (F.col("line_sum") * num(tax_rate)).cast("decimal(18,2)")
    joined = bills.join(bill_sums(items), "bill_id").withColumn("tax", tax)
    gap = F.col("bill_total") - (F.col("line_sum") + F.col("tax"))
    return joined.select("bill_id", *[F.col(c).cast("double").alias(c) for c in ("bill_total", "line_sum", "tax")], gap.cast("double").alias("gap"), F.when(F.col("bill_total").isNotNull(), F.abs(gap) < 1).alias("match"))


def total_mismatch(bills: DataFrame, items: DataFrame, share: str = "0.02", least: str = "10") -> DataFrame:
    """Bills whose total differs from the sum of their lines by more than 2 % of it and more than ten units."""
    joined = bills.join(bill_sums(items), "bill_id").withColumn("bill_total", F.coalesce("bill_total", "line_sum"))
    gap = F.abs(F.col("bill_total") - F.col("line_sum"))
    wrong = joined.filter(gap > F.greatest(F.col("line_sum") * num(share), num(least).cast("decimal(26,4)")))
    return wrong.select("bill_id", F.col("bill_total").cast("double").alias("billed"), F.col("line_sum").cast("double").alias("benchmark"), (F.col("bill_total") - F.col("line_sum")).cast("double").alias("difference"))


def output_validation(bills: DataFrame, items: DataFrame, large: str = "100000", drift: str = "5") -> DataFrame:
    """Per bill: whether it has lines, and how many warnings of each kind."""
    per = items.groupBy("bill_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("amount") > num(large)).alias("n_large"),
        F.count_if((F.col("amount") < 0) & ~any_keyword(F.col("description"), ["return"])).alias("n_negative"),
        F.sum("amount").alias("_sum"),
        ((F.count_distinct("amount") == 1) & (F.count("*") > 3)).alias("all_equal"),
    )
    joined = bills.join(per, "bill_id", "left")
    away = F.abs(F.col("bill_total") - F.col("_sum")) * 100 > F.col("bill_total") * num(drift)
    mismatch = F.coalesce((F.col("bill_total") > 0) & (F.col("_sum") > 0) & away, F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = joined.select("bill_id", zero("n_lines").alias("n_lines"), zero("n_large").alias("n_large"), zero("n_negative").alias("n_negative"), mismatch.alias("total_mismatch"), F.coalesce("all_equal", F.lit(False)).alias("all_equal"))
    return out.select("*", (F.col("n_lines") > 0).alias("is_valid"))


def procedure_keywords(procedures: DataFrame, stop_words=rules.PROCEDURE_STOP_WORDS, least: int = 5) -> DataFrame:
    """Per bill the sorted keywords of its documented procedures: alphanumeric words of some length, stop words left out."""
    words = F.split(F.lower(F.col("procedure")), r"[/\s-]+")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    fine = F.filter(clean, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words))
    return procedures.groupBy("bill_id").agg(F.count("*").alias("n_procedures"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(fine)))).alias("keywords"))


#: Fields without which a bill is told to be incomplete.
REQUIRED = ("hospital_name", "bill_number", "patient_name")


def output_warnings(bills: DataFrame, items: DataFrame, required: tuple[str, ...] = REQUIRED, large: str = "100000", drift: str = "5", same: int = 3) -> DataFrame:
    """bill_id, is_valid and warnings of every bill: those of its lines in their order, then of its total, its missing fields and equal amounts.

    A bill without lines is not valid and has that one warning.  A line without an amount counts as 0; blank fields are missing.
    """
    amount, low = F.coalesce("amount", F.lit(0).cast("decimal(12,2)")), F.lower(F.coalesce("description", F.lit("")))
    line = items.select("bill_id", "pos", amount.alias("_a"), (F.contains(low, F.lit("return"))).alias("_r"))
    per = line.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_a", "_r"))).alias("_x"), F.sum("_a").alias("_sum"), ((F.count_distinct("_a") == 1) & (F.count("*") > same)).alias("_same"))
    number = lambda i: (i + 1).cast("string")
    high = lambda x, i: F.when(x["_a"] > num(large), F.concat(F.lit("Line "), number(i), F.lit(" has an unusually high amount: ₹"), F.format_number(x["_a"], 2)))
    below = lambda x, i: F.when((x["_a"] < 0) & ~x["_r"], F.concat(F.lit("Line "), number(i), F.lit(" is negative and no return")))
    lines = F.flatten(F.transform("_x", lambda x, i: F.array(high(x, i), below(x, i))))
    total, whole = F.coalesce(F.col("bill_total").cast("double"), F.lit(0.0)), F.col("_sum").cast("double")
    away = F.abs(total - whole) / total * 100
    gap = F.when((total > 0) & (whole > 0) & (away > float(drift)), F.concat(F.lit("The bill says ₹"), F.format_number(total, 2), F.lit(", its lines ₹"), F.format_number(whole, 2)))
    absent = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]))
    missing = F.when(F.size(absent) > 0, F.concat(F.lit("Missing fields: "), F.array_join(absent, ", ")))
    equal = F.when(F.col("_same"), F.lit("All lines have the same amount"))
    told = F.array_compact(F.concat(lines, F.array(gap, missing, equal)))
    joined = bills.join(per, "bill_id", "left")
    none = F.col("_x").isNull()
    return joined.select("bill_id", (~none).alias("is_valid"), F.when(none, F.array(F.lit("No lines were read"))).otherwise(told).alias("warnings"))


def numeric_lines(items: DataFrame, raw: str = "amount", kind: str = "decimal(18,2)") -> tuple[DataFrame, DataFrame]:
    """Lines whose raw amount is a number above 0, as ``kind``, and those without one, with ``reason``; 0 and less is in neither."""
    value = F.col(raw).try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    marked = items.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    good = marked.filter("_fine").withColumn(raw, F.col(raw).try_cast("double").try_cast(kind)).filter(F.col(raw) > 0)
    return good.drop("_fine"), marked.filter("NOT _fine").drop("_fine").withColumn("reason", F.lit("missing_or_invalid_amount"))


def procedure_charges(items: DataFrame, procedures: DataFrame, words=rules.PROCEDURE_WORDS, **how) -> DataFrame:
    """Positive lines that hold a procedure word or a keyword of the bill's own documented procedures."""
    per = procedure_keywords(procedures, **how)
    joined = items.filter("amount > 0").join(per, "bill_id")
    low = F.lower("description")
    return joined.filter(any_keyword(F.col("description"), words) | F.exists("keywords", lambda k: F.contains(low, k)))


def positional_discount(items: DataFrame, procedures: DataFrame, words=rules.PROCEDURE_WORDS, least: str = "100", **how) -> DataFrame:
    """Bills with two or more procedures whose charges exceed 100 / 50 / 25 % of the amounts, largest first."""
    charges = procedure_charges(items, procedures, words, **how).filter("n_procedures >= 2")
    turn = F.row_number().over(Window.partitionBy("bill_id").orderBy(F.desc("amount"), "pos"))
    first, second, rest = map(F.lit, rules.POSITION_SHARES)
    share = F.when(turn == 1, first).when(turn == 2, second).otherwise(rest)
    per = charges.select("bill_id", "amount", (F.col("amount") * share).alias("expected")).groupBy("bill_id").agg(F.count("*").alias("n_charges"), F.sum("amount").alias("billed"), F.sum("expected").alias("expected"))
    over = per.filter((F.col("n_charges") >= 2) & (F.col("billed") - F.col("expected") > num(least)))
    return over.select("bill_id", "n_charges", *[F.col(c).cast("double").alias(c) for c in ("billed", "expected")], (F.col("billed") - F.col("expected")).cast("double").alias("overcharge"))


def phantom_consultations(items: DataFrame, procedures: DataFrame, words=("consult",)) -> DataFrame:
    """Bills with more consultations than documented procedures and one, with the estimated excess."""
    billed = items.filter(any_keyword(F.col("description"), words)).groupBy("bill_id").agg(F.count("*").alias("billed_count"), F.sum("amount").alias("billed"))
    documented = procedures.groupBy("bill_id").agg(F.count("*").alias("documented"))
    joined = billed.join(documented, "bill_id", "left").withColumn("documented", F.coalesce("documented", F.lit(0)))
    over = joined.filter(F.col("billed_count") > F.col("documented") + 1)
    estimate = F.col("billed").cast("double") * ((F.col("billed_count") - F.col("documented")) / F.col("billed_count"))
    return over.select("bill_id", "billed_count", "documented", F.col("billed").cast("double").alias("billed"), estimate.alias("overcharge"))


def late_settlements(claims: DataFrame, limit_days: int = 15) -> DataFrame:
    """Claims decided more than ``limit_days`` after discharge; unknown days are not late."""
    days = F.date_diff("decision_date", "discharge_date")
    return claims.withColumn("days", days).filter(F.col("days") > limit_days)


def sla_breaches(claims: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row for each duration column that exceeds its limit."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(c) > n, F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("value"), F.lit(n).alias("allowed"))) for c, n in limits.items()])))
    return claims.select("bill_id", each.alias("x")).select("bill_id", "x.*")


def amount_bands(spark: SparkSession, bands=rules.AMOUNT_BANDS) -> DataFrame:
    """The listed bands as a table."""
    return spark.createDataFrame(list(bands), "department string, band int, min_amount int, max_amount int, procedure string, band_rate int")


def band_matches(items: DataFrame, bands: DataFrame | None = None, factor: str = "1.5", small: int = 10_000) -> DataFrame:
    """Lines whose department has a band that holds the amount (up to ``factor`` times its top) and whose rate it exceeds ``factor`` times: the first such band.

    Bands of more than ``small`` rows are joined by a shuffle.
    """
    bands = amount_bands(items.sparkSession) if bands is None else bands
    hint = "broadcast" if bands.limit(small + 1).count() <= small else "merge"
    joined = items.join(bands.hint(hint), "department")
    hit = joined.filter((F.col("amount") >= F.col("min_amount")) & (F.col("amount") <= F.col("max_amount") * num(factor)) & (F.col("amount") > F.col("band_rate") * num(factor)))
    return keep_first(hit, ["bill_id", "pos"], ["band"])


def unmatched(items: DataFrame, found: DataFrame) -> DataFrame:
    return items.join(found.select("bill_id", "pos").distinct(), ["bill_id", "pos"], "left_anti")


def cascade(items: DataFrame, *strategies) -> DataFrame:
    """Strategies (lines -> issue rows with bill_id and pos) in turn, each on what the earlier ones left."""
    out, rest = None, items
    for strategy in strategies:
        found = strategy(rest)
        out = found if out is None else out.unionByName(found)
        rest = unmatched(rest, found)
    return out

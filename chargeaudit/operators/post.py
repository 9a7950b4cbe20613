"""After the detectors: validation against source lines, deduplication, grouping, money summaries, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.predicates import any_keyword

MONEY = "decimal(18,2)"


def normalised(description: Column, prefixes=rules.DEPARTMENT_PREFIXES) -> Column:
    """Lower case, the first listed department prefix off, signs removed, blanks made one."""
    low = F.lower(description)
    cut = low
    for p in reversed(prefixes):
        cut = F.when(low.startswith(p), F.substring(low, len(p) + 1, 1 << 30)).otherwise(cut)
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def rank(confidence: Column) -> Column:
    return F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in rules.CONFIDENCE_RANK.items()], F.lit(0))


def money(c: str) -> Column:
    return F.col(c).cast(MONEY)


def in_order(*parts: DataFrame) -> DataFrame:
    """All issue rows of several detectors, with the detector's place as ``stage``."""
    out = parts[0].withColumn("stage", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("stage", F.lit(i)))
    return out


def validated(issues: DataFrame, items: DataFrame, times: int = 3) -> DataFrame:
    """High issues become medium if no line of the bill has their text and amount, or if they are over three times their benchmark.

    Texts match if one holds the other; empty descriptions match nothing.  Adds ``note``.
    """
    line = F.struct(F.lower("description").alias("text"), money("amount").alias("amount"))
    lines = items.groupBy(F.col("bill_id").alias("_bill")).agg(F.collect_set(line).alias("_lines"))
    text = F.lower(F.trim(F.split_part("description", F.lit(" —"), F.lit(1))))
    same = lambda x: (F.contains(x["text"], text) | F.contains(text, x["text"])) & (F.length(x["text"]) > 0) & (F.abs(x["amount"] - money("billed")) < 1)
    # one join by bill: the issues are not joined with themselves again and stay dealt by bill
    found = F.when(F.col("confidence") == "high", F.coalesce(F.exists("_lines", same), F.lit(False)))
    joined = issues.join(lines.hint("merge"), F.col("bill_id") == F.col("_bill"), "left").select(*issues.columns, found.alias("_found"))
    note = F.when(F.col("confidence") != "high", F.lit(None).cast("string")).when(~F.col("_found"), "source row not found").when(money("billed") > money("benchmark") * times, "over three times the benchmark")
    out = joined.withColumn("note", note)
    return out.withColumn("confidence", F.when(F.col("note").isNotNull(), "medium").otherwise(F.col("confidence"))).drop("_found")


def deduplicated(issues: DataFrame) -> DataFrame:
    """One issue for each bill, normalised text and amount: of highest confidence, then overcharge, then first."""
    w = Window.partitionBy("bill_id", normalised(F.col("description")), money("billed")).orderBy(F.desc(rank(F.col("confidence"))), F.desc(F.coalesce(money("overcharge"), F.lit(0).cast(MONEY))), "stage", "pos")
    return issues.select("*", F.row_number().over(w).alias("_turn")).filter("_turn = 1").drop("_turn")


def lab_groups(issues: DataFrame, words=rules.LAB_ISSUE_WORDS, more_than: int = 2) -> DataFrame:
    """Bills with more than two laboratory issues get one issue in their place."""
    lab = any_keyword(F.col("description"), words)
    n = F.count_if("_lab").over(Window.partitionBy("bill_id"))
    marked = issues.withColumn("_lab", lab).select("*", n.alias("_n"))
    cols = ["bill_id", "issue_type", "description", "billed", "benchmark", "confidence", "n_items"]
    rest = marked.filter(~F.col("_lab") | (F.col("_n") <= more_than)).withColumn("n_items", F.lit(1).cast("long")).select(cols)
    per = marked.filter(F.col("_lab") & (F.col("_n") > more_than)).groupBy("bill_id").agg(F.count("*").alias("n_items"), F.sum(money("billed")).alias("b"), F.sum(money("benchmark")).alias("m"))
    priced = F.coalesce(F.col("m"), F.lit(0)) > 0
    grouped = per.select(
        "bill_id", F.lit("missing_itemization").alias("issue_type"), F.concat(F.lit("Laboratory tests — "), F.col("n_items"), F.lit(" items for verification")).alias("description"),
        F.col("b").cast("double").alias("billed"), F.when(priced, F.col("m").cast("double")).alias("benchmark"), F.when(priced, "medium").otherwise("low").alias("confidence"), "n_items",
    )
    return rest.unionByName(grouped)


def analysis(bills: DataFrame, issues: DataFrame, approved: Column, rejected: Column, unverified: Column | None = None, weight: float = 0.6) -> DataFrame:
    """Per bill: totals, confirmed and unverified amounts, and the range that may be recovered."""
    is_ = lambda *c: F.col("confidence").isin(*c)
    unverified = unverified if unverified is not None else is_("low", "medium") & F.col("issue_type").isin(*rules.PACKAGE_TYPES)
    over = money("overcharge")
    per = issues.groupBy("bill_id").agg(
        F.count("*").alias("n_issues"), F.sum(F.when(is_("high"), over)).alias("_high"), F.sum(F.when(is_("medium"), over)).alias("_medium"), F.sum(F.when(unverified, money("billed"))).alias("_open")
    )
    joined = bills.join(per, "bill_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(MONEY)).cast("double")
    total = F.coalesce("bill_total", F.lit(0)).cast(MONEY)
    return joined.select(
        "bill_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), total.cast("double").alias("total_bill"), approved.cast("double").alias("total_approved"), rejected.cast("double").alias("total_rejected"),
        (total - F.coalesce(approved.cast(MONEY), F.lit(0))).cast("double").alias("patient_liability"),
        zero("_high").alias("verified"), zero("_open").alias("unverified"), zero("_high").alias("min_recoverable"), (zero("_high") + zero("_medium") * weight).alias("max_recoverable"),
    )


def recovery_percent(low: Column, verified: Column) -> Column:
    return F.when(verified > 0, F.round(low / verified * 100))


def scenario(analysed: DataFrame, issues: DataFrame, has_policy: Column) -> DataFrame:
    """bill_id and scenario, from insurance evidence, confirmed overcharges and claim issues."""
    per = issues.groupBy("bill_id").agg(F.bool_or(F.col("confidence") == "high").alias("_high"), F.bool_or(F.col("issue_type").isin(*rules.CLAIM_TYPES)).alias("_claim"))
    joined = analysed.join(per, "bill_id", "left")
    no = F.lit(False)
    insured = has_policy | (F.coalesce("total_approved", F.lit(0.0)) > 0) | (F.coalesce("total_rejected", F.lit(0.0)) > 0)
    strong = (F.col("verified") > 0) | F.coalesce("_high", no)
    claim = F.coalesce("_claim", no) | (F.coalesce("total_rejected", F.lit(0.0)) > 0)
    name = (
        F.when(~insured & ~strong, "A_cash_clarification").when(~insured & strong, "B_cash_objection").when(insured & claim, "C_insurance_dispute").when(insured & strong, "D_hospital_overcharge_only").otherwise("A_cash_clarification")
    )
    return joined.withColumn("scenario", name).drop("_high", "_claim")


def letters_for(scenarios: DataFrame, matrix: dict = rules.LETTER_MATRIX) -> DataFrame:
    """One row for each letter that a bill's scenario calls for."""
    names = F.coalesce(*[F.when(F.col("scenario") == s, F.array(*map(F.lit, types))) for s, types in matrix.items()])
    return scenarios.select("bill_id", "scenario", F.posexplode(names).alias("letter_no", "letter_type"))


def top_issues(issues: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("bill_id").orderBy(F.desc(F.coalesce(money("overcharge"), F.lit(0).cast(MONEY))), "stage", "pos")
    return issues.select("*", F.row_number().over(w).alias("place")).filter(F.col("place") <= n)


# What makes a letter invalid.
LETTER_PLACEHOLDERS = ("[Hospital Name]", "[Patient Name]", "[Bill Number]", "[Policy Number]", "[Claim Number]", "[Insurance Company]", "[INSURER NAME]", "[HOSPITAL NAME]")
LETTER_FORBIDDEN = ("overcharges detected", "demand refund", "demand immediate", "irdai violations", "regulation violations")


def letter_problem(content: Column, scenario: Column, verified: Column) -> Column:
    """Why a letter may not be sent; null if it may."""
    low = F.lower(content)
    unfilled = F.coalesce(*[F.when(F.contains(content, F.lit(p)), F.lit(p)) for p in LETTER_PLACEHOLDERS])
    forbidden = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in LETTER_FORBIDDEN])
    nothing = (F.coalesce(verified, F.lit(0.0)) == 0) & (F.contains(content, F.lit("Refund of ₹0")) | F.contains(low, F.lit("refund of rs. 0")))
    return (
        F.when(content.isNull() | (F.length(F.trim(content)) < 100), "too short")
        .when(unfilled.isNotNull(), F.concat(F.lit("placeholder: "), unfilled))
        .when(content.rlike(r"\bn\d{1,7}\b"), "currency artifact")
        .when((scenario == "A_cash_clarification") & forbidden.isNotNull(), F.concat(F.lit("confrontational: "), forbidden))
        .when(nothing, "refund of nothing")
    )


def rupees(amount: Column, places: int = 2) -> Column:
    return F.concat(F.lit("₹"), F.format_number(amount, places))


def section(issues: DataFrame, name: str, limit: int = 10, evidence: int = 0) -> DataFrame:
    """Per bill the numbered lines of its issues in order, the first ``limit`` of them and how many more.

    Under each stand the first ``evidence`` lines of its evidence, if the issues carry any; blank ones are passed over.
    """
    line = F.concat(F.col("description"), F.lit(": billed "), rupees(money("billed")), F.coalesce(F.concat(F.lit(", reference "), rupees(money("benchmark"))), F.lit("")))
    if evidence and "evidence" in issues.columns:
        said = F.slice(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.trim(e) != ""), 1, evidence)
        line = F.concat(line, F.array_join(F.transform(said, lambda e: F.concat(F.lit("\n   - "), e)), ""))
    per = issues.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("stage", "pos", line.alias("line")))).alias("x"), F.sum(money("overcharge")).alias("_over"), F.sum(money("billed")).alias("_billed"))
    lines = F.transform(F.slice("x", 1, limit), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    more = F.when(F.size("x") > limit, F.array(F.concat(F.lit("and "), F.size("x") - limit, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return per.select("bill_id", F.array_join(F.concat(lines, more), "\n").alias(name), F.coalesce(F.col("_over"), F.lit(0)).cast(MONEY).alias(f"{name}_over"), F.col("_billed").alias(f"{name}_billed"))


INTRO = {
    "professional": "We have reviewed the bill below against published reference prices and ask for a written explanation.",
    "firm": "The charges below exceed published reference prices. We expect a corrected bill.",
    "polite": "Could you please help us to understand the charges below?",
}


def hospital_letter(analysed: DataFrame, issues: DataFrame, tone: str = "professional", limit: int = 10) -> DataFrame:
    """bill_id and content: confirmed overcharges first, charges to verify after them, with subtotals."""
    sure, rest = section(issues.filter("confidence = 'high'"), "a", limit), section(issues.filter("confidence <> 'high'"), "b", limit)
    j = analysed.join(sure, "bill_id", "left").join(rest, "bill_id", "left")
    part = lambda title, c, total: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n\n{title}\n"), F.col(c), F.lit("\nSubtotal: "), rupees(F.col(total)))).otherwise(F.lit(""))
    head = F.concat(F.lit("Subject: Review of bill "), F.col("bill_id").cast("string"), F.lit(f"\n\n{INTRO[tone]}\nTotal billed: "), rupees(F.col("total_bill").cast(MONEY)))
    text = F.concat(head, part("A. Charges above reference", "a", "a_over"), part("B. Charges to verify", "b", "b_billed"), F.lit("\n\nPlease answer within 15 days with the itemised records."))
    return j.select("bill_id", text.alias("content"))


def issue_types(issues: DataFrame, titles: dict[str, str], priorities: dict[str, int]) -> DataFrame:
    """Per bill and issue type: title, priority, number and total, as the sections of a letter."""
    title = F.coalesce(*[F.when(F.col("issue_type") == k, F.lit(v)) for k, v in titles.items()])
    priority = F.coalesce(*[F.when(F.col("issue_type") == k, F.lit(v)) for k, v in priorities.items()], F.lit(0))
    per = issues.groupBy("bill_id", "issue_type").agg(F.count("*").alias("n"), F.sum(money("overcharge")).cast("double").alias("total"))
    return per.select("bill_id", title.alias("title"), priority.alias("priority"), "n", "total").filter("title IS NOT NULL")


def cited(evidence: Column, sources: dict[str, str]) -> Column:
    """The sorted names of the regulations whose marks the text holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(evidence, F.lit(mark)), F.lit(name)) for mark, name in sources.items()])))




def clarification_letter(analysed: DataFrame, issues: DataFrame) -> DataFrame:
    """bill_id and content: a polite request about charges that are not confirmed; bills without such charges get a short one."""
    open_ = issues.filter("confidence IN ('low', 'medium')")
    j = analysed.join(section(open_, "a", 50), "bill_id", "left")
    body = F.coalesce(F.concat(F.lit("\n\nCharges to clarify:\n"), F.col("a"), F.lit("\n\nFor each please give the exact name and code, whether it is a package, and your published tariff.")), F.lit(""))
    head = F.concat(F.lit("Request for clarification of bill "), F.col("bill_id").cast("string"), F.lit("\nTotal: "), rupees(F.col("total_bill").cast(MONEY), 0))
    return j.select("bill_id", F.concat(head, body, F.lit("\n\nPlease answer in writing within 14 days.")).alias("content"))


def insurer_letter(analysed: DataFrame, issues: DataFrame, evidence: int = 2) -> DataFrame:
    """bill_id and content: the claim's amounts and its disputed decisions with their first evidence, for bills with a rejected amount or a claim issue."""
    claim = section(issues.filter(F.col("issue_type").isin(*rules.CLAIM_TYPES)), "a", 50, evidence)
    j = analysed.join(claim, "bill_id", "left").filter(F.col("a").isNotNull() | (F.col("total_rejected") > 0))
    line = lambda name, c: F.concat(F.lit(f"\n{name}: "), rupees(F.coalesce(F.col(c), F.lit(0.0)).cast(MONEY), 0))
    head = F.concat(F.lit("Grievance about the claim for bill "), F.col("bill_id").cast("string"), line("Claimed", "total_bill"), line("Approved", "total_approved"), line("Rejected", "total_rejected"))
    body = F.coalesce(F.concat(F.lit("\n\nDecisions to review:\n"), F.col("a")), F.lit(""))
    return j.select("bill_id", F.concat(head, body, F.lit("\n\nPlease give the clause and basis of each deduction within 15 working days.")).alias("content"))


def patient_summary(analysed: DataFrame, issues: DataFrame, limit: int = 10) -> DataFrame:
    """bill_id and content: totals and the first issues of each confidence."""
    j = analysed
    for level in rules.CONFIDENCES:
        j = j.join(section(issues.filter(F.col("confidence") == level), level, limit), "bill_id", "left")
    titles = {"high": "Confirmed excess", "medium": "To verify", "low": "To clarify"}
    parts = [F.coalesce(F.concat(F.lit(f"\n\n{titles[level]}:\n"), F.col(level)), F.lit("")) for level in rules.CONFIDENCES]
    head = F.concat(F.lit("Summary of bill "), F.col("bill_id").cast("string"), F.lit("\nTotal: "), rupees(F.col("total_bill").cast(MONEY), 0), F.lit("\nConfirmed excess: "), rupees(F.col("verified").cast(MONEY), 0))
    return j.select("bill_id", F.concat(head, *parts, F.lit("\n\nKeep the bill, the receipts and proof of every letter.")).alias("content"))


# Issues that stand for a whole package, and those of lines without a benchmark.
PACKAGES = ("surgical_package", "room_stay_package")
UNPRICED = "missing_itemization"


def result_text(bills: DataFrame, issues: DataFrame, late_after: int = 15) -> DataFrame:
    """bill_id, summary and recommendations of each of ``bills`` (bill_id, days from discharge to rejection), from one aggregate over its issues.

    Nulls among the issues' amounts count as nothing; a bill without issues is told so.
    """
    high, package, open_ = F.col("confidence") == "high", F.col("issue_type").isin(*PACKAGES), (F.col("confidence") == "low") & (F.col("issue_type") == UNPRICED)
    per = issues.groupBy(F.col("bill_id").alias("_bill")).agg(F.count_if(high).alias("_high"), F.sum(F.when(high, money("overcharge"))).alias("_over"), F.count_if(package).alias("_packages"), F.count_if(open_).alias("_open"))
    j = bills.join(per.hint("merge"), F.col("bill_id") == F.col("_bill"), "left")
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    over = F.concat(F.col("_high"), F.lit(" confirmed overcharge(s) totalling "), rupees(F.coalesce("_over", F.lit(0).cast(MONEY)), 0))
    found = F.array_compact(F.array(F.when(some("_high"), over), F.when(some("_packages"), F.concat("_packages", F.lit(" package(s) whose procedure is to be verified"))), F.when(some("_open"), F.concat("_open", F.lit(" item(s) to be clarified")))))
    summary = F.when(F.size(found) > 0, F.concat(F.lit("Found: "), F.array_join(found, "; "), F.lit("."))).otherwise(F.lit("No issues found; the bill agrees with the benchmarks at hand."))
    advice = F.array_compact(
        F.array(
            F.when(some("_packages"), F.lit("Before paying, ask for the exact procedure and its package rate.")),
            F.when(some("_high"), F.concat(F.lit("Challenge "), over, F.lit(" with the reference prices."))),
            F.when(some("_open"), F.lit("Ask for an itemised breakdown of charges without a benchmark.")),
            F.when(F.col("days") > late_after, F.lit("Escalate the delayed settlement to the regulator.")),
        )
    )
    return j.select("bill_id", summary.alias("summary"), F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Nothing needs to be done now."))).alias("recommendations"))


def letter_run(scenarios: DataFrame, issues: DataFrame) -> DataFrame:
    """All letters that scenarios call for, written and checked: bill_id, letter_type, content, reason (null if it may be sent)."""
    wanted = letters_for(scenarios)
    written = {
        "hospital_professional": hospital_letter(scenarios, issues), "hospital_clarification": clarification_letter(scenarios, issues),
        "insurer": insurer_letter(scenarios, issues), "patient_summary": patient_summary(scenarios, issues),
    }
    out = None
    for kind, letters in written.items():
        part = wanted.filter(F.col("letter_type") == kind).join(letters.hint("merge"), "bill_id")
        out = part if out is None else out.unionByName(part)
    verified = scenarios.select("bill_id", "verified")
    return out.join(verified.hint("merge"), "bill_id").withColumn("reason", letter_problem(F.col("content"), F.col("scenario"), F.col("verified"))).drop("verified")


class Sections:
    """A registry of letter sections: when one applies, what it says, and how early it comes.

    ``applies`` is a Column over issue rows; ``builds`` makes the section's text of its rows' aggregates ``n`` and ``total``.
    """

    def __init__(self) -> None:
        self.entries: dict[str, tuple[Column, Column, int]] = {}

    def register(self, name: str, applies: Column, builds: Column, priority: int) -> None:
        self.entries[name] = (applies, builds, priority)

    def written(self, issues: DataFrame) -> DataFrame:
        """bill_id and content: the sections that apply to each bill, highest priority first."""
        per = issues.groupBy("bill_id").agg(*[F.struct(F.count_if(a).alias("n"), F.coalesce(F.sum(F.when(a, money("overcharge"))), F.lit(0).cast(MONEY)).alias("total")).alias(f"_{k}") for k, (a, _, _) in self.entries.items()])
        parts = []
        for k, (_, builds, priority) in self.entries.items():
            one = per.select("bill_id", F.col(f"_{k}.n").alias("n"), F.col(f"_{k}.total").alias("total")).filter("n > 0")
            parts.append(one.select("bill_id", F.lit(-priority).alias("_order"), F.lit(k).alias("_name"), builds.alias("_text")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("bill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_name", "_text"))), lambda x: x["_text"]), "\n").alias("content"))

"""Price checks by text: ceilings of drugs and devices, and rates of laboratory tests, with evidence.

Prices are tables of name and rate.  Without a table there is nothing to compare with, and no line is an issue.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.predicates import any_keyword
from . import detect as D
from . import matching as M

# Words of the device with a search of its own, that search, and what its rows must name.
SPECIAL = {"words": ("stent", "drug-eluting", "drug eluting", "des"), "question": "drug eluting stent coronary stent DES", "must": "stent", "any": ("drug", "eluting", "des")}
LAB_STEPS = ((0.65, "high"), (0.55, "medium"))
PHARMACY_STEPS = ((0.8, "high"), (0.65, "medium"))
SUMMARIES = ("medicine charges", "pharmacy charges", "drug charges", "total medicines", "total drugs", "consumables", "medical supplies")


def rupees(label: str, amount: Column) -> Column:
    return F.concat(F.lit(f"{label}: ₹"), F.format_number(amount, 2))


def priced(lines: DataFrame, kind: str | Column, confidence: str | Column = "high") -> DataFrame:
    """Issues of lines with matched, match_rate, similarity and, where there is more to say, note."""
    note = F.col("note") if "note" in lines.columns else F.lit(None).cast("string")
    said = M.evidence(rupees("Benchmark", F.col("match_rate")), rupees("Billed", F.col("amount")), F.concat(F.lit("Matched entry: "), F.col("matched")), note)
    return D.issues(lines.withColumn("evidence", said), kind, F.col("amount"), F.col("match_rate"), confidence, None, "matched", "similarity", "evidence")


def nearest_price(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Lines with matched, match_rate and similarity of the entry that is most like their description; lines like none are left out."""
    asked = items.select(F.col("description").alias("text"))
    found = M.text_matches(asked, prices, 1, 0.0, ("rate",)).select(F.col("text").alias("description"), F.col("name").alias("matched"), F.col("rate").alias("match_rate"), "similarity")
    return items.join(found.hint("merge"), "description")


def drug_ceilings(items: DataFrame, prices: DataFrame | None, tolerance: str = "1.2") -> DataFrame:
    """Lines above ``tolerance`` times the ceiling of the most similar entry, however far that is and whatever the quantity."""
    if prices is None:
        return priced(M.code_or_text(items, None).limit(0), "drug_overcharge")
    return priced(nearest_price(items, prices).filter((F.col("match_rate") > 0) & (F.col("amount") > F.col("match_rate") * D.num(tolerance))), "drug_overcharge")


def special_price(prices: DataFrame, question: str, must: str, any_of: tuple[str, ...], n: int = 10) -> DataFrame:
    """One row, or none: the best answer to a fixed question among its first ``n`` that names what it must."""
    found = M.text_matches(prices.sparkSession.createDataFrame([(question,)], "text string"), prices, n, 0.0, ("rate",))
    fit = found.filter(any_keyword(F.col("name"), (must,)) & any_keyword(F.col("name"), any_of))
    return fit.agg(F.min_by(F.struct("name", "rate"), "rank").alias("x")).filter("x IS NOT NULL").select("x.*")


def device_ceilings(items: DataFrame, prices: DataFrame | None, special: dict = SPECIAL, tolerance: str = "1.05", least: float = 0.5) -> DataFrame:
    """Lines above ``tolerance`` times a device's ceiling: that of the special search for lines of its words, or else of a similar entry."""
    if prices is None:
        return priced(M.code_or_text(items, None).limit(0), "device_overcharge")
    best = special_price(prices, special["question"], special["must"], special["any"]).select(F.col("name").alias("_name"), F.col("rate").alias("_rate"), F.lit(True).alias("_special"))
    over = lambda rate: (rate > 0) & (F.col("amount") > rate * D.num(tolerance))
    marked = items.withColumn("_special", any_keyword(F.col("description"), special["words"])).join(F.broadcast(best), "_special", "left")  # one row
    first = F.coalesce(over(F.col("_rate")), F.lit(False))
    own = marked.filter(first).select(*items.columns, F.col("_name").alias("matched"), F.col("_rate").alias("match_rate"), F.lit(1.0).alias("similarity"), F.lit("Found by the search for this device").alias("note"))
    rest = nearest_price(marked.filter(~first).select(*items.columns), prices).filter((F.col("similarity") >= least) & over(F.col("match_rate")))
    return priced(own, "device_overcharge").unionByName(priced(rest, "device_overcharge"))


def pharmacy_ceilings(items: DataFrame, prices: DataFrame | None, margin: str = "1.1", steps=PHARMACY_STEPS, totals: tuple[str, ...] = SUMMARIES) -> DataFrame:
    """Lines above ``margin`` times the ceiling of the most similar entry for their quantity; how similar it is decides the confidence.

    Lines that sum a category up are no single drug: their descriptions are found once each and left out by an anti-join.  Without a
    quantity a line counts once; entries without a ceiling and lines of no similar entry are left out.
    """
    if prices is None:
        return priced(M.code_or_text(items, None).limit(0), "drug_overcharge")
    sums = items.select("description").distinct().filter(any_keyword(F.col("description"), totals))
    single = items.join(sums.hint("merge"), "description", "left_anti")
    asked = single.select(F.col("description").alias("text"))
    found = M.text_matches(asked, prices, 1, min(x for x, _ in steps), ("rate",)).select(F.col("text").alias("description"), F.col("name").alias("matched"), F.col("rate").alias("_ceiling"), "similarity")
    quantity = F.coalesce("quantity", F.lit(1))
    both = single.join(found.hint("merge"), "description").withColumn("match_rate", F.col("_ceiling") * quantity)
    level = F.lit(None).cast("string")
    for least, name in reversed(steps):
        level = F.when(F.col("similarity") >= least, name).otherwise(level)
    said = F.concat_ws(" × ", rupees("Ceiling", F.col("_ceiling")), F.format_number(quantity, 2))
    over = both.filter((F.col("_ceiling") > 0) & (F.col("amount") > F.col("match_rate") * D.num(margin))).withColumn("note", said)
    return priced(over, "drug_overcharge", level)


def lab_rates(items: DataFrame, benchmarks: DataFrame | None, texts: tuple[str, ...], tolerance: str = "1.5", suspicious: int = 5, consumables: tuple[str, ...] = rules.CONSUMABLES, steps=LAB_STEPS) -> DataFrame:
    """Tests above ``tolerance`` times the rate found by the better of their texts, and reviews of those without a rate.

    Consumables and lines without a text or a positive amount are left out.  More than ``suspicious`` times the rate
    makes a high confidence medium, for the match may be wrong.
    """
    if benchmarks is None:
        return priced(M.code_or_text(items, None).limit(0), "procedure_overcharge")
    test = (F.trim("description") != "") & ~any_keyword(F.col("description"), consumables)
    both = M.beside_best(items.filter("amount > 0"), benchmarks, texts, how="left", keep=test, by=("description",)).select(*items.columns, "matched", "match_rate", "similarity")
    level = F.lit("low")
    for least, name in reversed(steps):
        level = F.when(F.col("similarity") >= least, name).otherwise(level)
    level = F.when((level == "high") & (F.col("amount") > F.col("match_rate") * F.lit(Decimal(suspicious))), "medium").otherwise(level)
    unknown = F.col("matched").isNull()
    shown = both.filter(unknown | (F.col("amount") > F.col("match_rate") * D.num(tolerance)))
    said = shown.withColumn("note", F.when(unknown, "No reliable benchmark").when(level != "high", "To be verified before it is disputed"))
    return priced(said, F.when(unknown, "missing_itemization").otherwise("procedure_overcharge"), level)


def unpriced_results(bills: DataFrame, items: DataFrame) -> DataFrame:
    """What an audit without benchmarks says of each bill: all of it is approved and unverified, nothing can be recovered."""
    per = items.groupBy("bill_id").agg(F.count("*").alias("n_items"), F.sum("amount").alias("_sum"))
    total = F.coalesce(F.nullif("bill_total", F.lit(0)), F.col("_sum"), F.lit(0)).cast("double")
    out = bills.join(per, "bill_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return out.select("bill_id", total.alias("total_bill"), total.alias("unverified"), F.lit(0.0).alias("verified"), F.lit(0.0).alias("recoverable"), F.concat(F.col("n_items"), F.lit(" lines were read, without benchmarks")).alias("summary"))


def single_threshold(items: DataFrame, kinds: dict[str, tuple[str, ...]], reference: Column, times: str = "1.5") -> DataFrame:
    """The older ruleset: lines above ``times`` their reference, whatever their kind; the first kind of which a description holds a word counts, others are left out."""
    kind = F.coalesce(*[F.when(any_keyword(F.col("description"), words), F.lit(name)) for name, words in kinds.items()])
    hit = items.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.col("amount") > reference * D.num(times)))
    return hit.select("bill_id", "pos", "kind", F.col("amount").cast("double").alias("billed"), reference.cast("double").alias("benchmark"))


def fallback_rates(items: DataFrame, own: DataFrame, key: str, common: Column, tolerance: str = "1.05") -> DataFrame:
    """Lines above ``tolerance`` times the rate of their ``key`` in ``own`` (key, device_rate), or else a common rate, and which of the two it is."""
    joined = items.join(own.hint("merge"), key, "left")
    rate = F.coalesce("device_rate", common)
    source = F.when(F.col("device_rate").isNull(), "common").otherwise("own")
    return joined.filter(F.col("amount") > rate * D.num(tolerance)).select("bill_id", "pos", F.col("amount").cast("double").alias("billed"), rate.cast("double").alias("benchmark"), source.alias("basis"))

"""Routing documents by their words, and splitting bills into episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import any_keyword, category_total, dispatch, episode, keyword_count
from ..functions import rules


def document_scores(items: DataFrame, signals: dict[str, tuple[str, ...]], lines: dict[str, tuple[str, ...]], totals=rules.CATEGORY_TOTALS) -> DataFrame:
    """Per bill: different signals of each list in its text, the share of lines of each kind, and whether it lists category totals."""
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]), " "))
    per = items.groupBy("bill_id").agg(
        text.alias("text"),
        F.count("*").alias("n_lines"),
        *[F.avg(any_keyword(F.col("description"), k).cast("double")).alias(f"{n}_share") for n, k in lines.items()],
        F.count_if((F.col("pos") <= 10) & category_total(F.col("description"), totals)).alias("n_totals"),
    )
    return per.select("*", *[keyword_count(F.col("text"), k).alias(f"{n}_score") for n, k in signals.items()]).drop("text")


def document_type(c=F.col) -> Column:
    """The ordered decision over the columns of :func:`document_scores`."""
    return (
        F.when((c("n_lines") >= 3) & (c("n_totals") >= 3), "hospital_bill")
        .when(c("insurance_score") >= 3, "insurance_document")
        .when((c("pharmacy_share") >= 0.6) | ((c("pharmacy_score") >= 5) & (c("pharmacy_share") >= 0.4)), "pharmacy_bill")
        .when((c("lab_share") >= 0.6) | ((c("lab_score") >= 5) & (c("lab_share") >= 0.4)), "lab_bill")
        .when(c("device_score") >= 3, "device_invoice")
        .when(c("hospital_score") >= 4, "hospital_bill")
        .when((c("pharmacy_score") > c("hospital_score")) & (c("pharmacy_score") >= 3), "pharmacy_bill")
        .when((c("lab_score") > c("hospital_score")) & (c("lab_score") >= 3), "lab_bill")
        .when((c("hospital_score") >= 2) | (c("n_lines") >= 3), "hospital_bill")
        .otherwise("unknown")
    )


def routed(items: DataFrame, signals: dict, lines: dict, totals=rules.CATEGORY_TOTALS) -> DataFrame:
    scored = document_scores(items, signals, lines, totals).withColumn("document_type", document_type())
    analyser = F.when(F.col("document_type") == "pharmacy_bill", "pharmacy").when(F.col("document_type") == "lab_bill", "lab").otherwise("hospital")
    return scored.withColumn("analyser", analyser)


def with_episode(items: DataFrame, **lists) -> DataFrame:
    return items.withColumn("episode", episode(F.col("description"), F.col("category"), **lists))


def episode_totals(items: DataFrame, bills: DataFrame, **lists) -> DataFrame:
    """Per bill and grouped episode: lines, total, percent of the bill, and the lines in order."""
    per = with_episode(items, **lists).filter("episode <> 'atomic'").groupBy("bill_id", "episode").agg(
        F.count("*").alias("n_lines"),
        F.sum("amount").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]), "; ").alias("components"),
    )
    share = F.try_divide(F.col("total").cast("double") * 100, F.col("bill_total").cast("double"))
    return per.join(bills.select("bill_id", "bill_total"), "bill_id", "left").select("bill_id", "episode", "n_lines", F.col("total").cast("double").alias("total"), share.alias("share_percent"), "components")


def category_lines(items: DataFrame, names=rules.CATEGORY_TOTALS) -> DataFrame:
    """Lines that are category totals, with the request to itemise them."""
    hit = items.filter(category_total(F.col("description"), names) & (F.col("amount") > 0))
    return hit.select("bill_id", "pos", F.concat(F.lower("description"), F.lit(" - itemization required")).alias("issue"), F.col("amount").cast("double").alias("billed"), F.lit("low").alias("confidence"))


def dispatched(items: DataFrame, lists: dict = rules.DISPATCH, devices_first: bool = True) -> DataFrame:
    """Positive lines with the check they get."""
    return items.filter(F.col("amount") > 0).withColumn("check", dispatch(F.col("description"), lists, devices_first))

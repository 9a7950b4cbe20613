"""Queries of document routing and episodes over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as R
from ..sources.bridge import BRIDGE, bills, line_items

# The part names are pairs of everyday words; these lists stand for the medical ones.
SIGNALS = {"hospital": ("large", "plate", "anvil", "old"), "pharmacy": ("ring", "bolt", "red", "hot", "small"), "lab": ("gear", "gizmo", "cold", "blue", "new"), "device": ("rod", "widget", "large rod"), "insurance": ("hot rod", "cold rod", "old rod", "new rod")}
LINES = {"pharmacy": ("ring", "bolt"), "lab": ("gear", "gizmo")}
TOTALS = ("red plate", "old anvil", "large gear", "blue rod", "hot ring")
EPISODES = {"surgical": ("anvil", "large rod"), "atomic": ("ring", "red"), "room": ("plate", "small", "hot"), "surgical_categories": ("promo",), "room_categories": ("economy",)}
DISPATCH = {"drug": ("ring", "red"), "device": ("rod", "bolt"), "diagnostic": ("gear",), "consultation": ("plate",), "consumable": ("gizmo",)}


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _score(words) -> str:
    return "(" + " + ".join(f"contains(text, '{w}')::INT" for w in words) + ")"


def _token(words) -> str:
    return "(" + " OR ".join(f"contains(' ' || lower(description) || ' ', ' {w} ') OR starts_with(lower(description), '{w} ') OR lower(description) = '{w}'" for w in words) + ")"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


EPISODE_SQL = f"""CASE WHEN lower(category) IN {_in(EPISODES['surgical_categories'])} OR {_has('lower(description)', EPISODES['surgical'])} THEN 'surgical'
  WHEN {_has('lower(description)', EPISODES['atomic'])} THEN 'atomic'
  WHEN lower(category) IN {_in(EPISODES['room_categories'])} OR {_token(EPISODES['room'])} THEN 'room_stay' ELSE 'atomic' END"""
DISPATCH_SQL = "CASE " + " ".join(f"WHEN {_has('lower(description)', DISPATCH[k])} THEN '{k}'" for k in ("device", "drug", "diagnostic", "consultation", "consumable")) + " ELSE 'unmatched' END"


def router(spark, sf_dir):
    out = R.routed(line_items(spark, sf_dir), SIGNALS, LINES, TOTALS)
    return out.select("bill_id", "n_lines", "pharmacy_share", "lab_share", *[f"{s}_score" for s in SIGNALS], "document_type", "analyser")


def episode_split(spark, sf_dir):
    return R.episode_totals(line_items(spark, sf_dir), bills(spark, sf_dir), **EPISODES)


def category_totals(spark, sf_dir):
    return R.category_lines(line_items(spark, sf_dir), TOTALS)


def atomic_dispatch(spark, sf_dir):
    items = R.with_episode(line_items(spark, sf_dir), **EPISODES).filter("episode = 'atomic'")
    return R.dispatched(items, DISPATCH).groupBy("bill_id", "check").agg(F.count("*").alias("n_lines"), F.sum("amount").cast("double").alias("amount"))


QUERIES = {"router": router, "episode_split": episode_split, "category_totals": category_totals, "atomic_dispatch": atomic_dispatch}
ORACLE_SQL = {
    "router": BRIDGE
    + f""", p AS (
  SELECT bill_id, lower(string_agg(description, ' ' ORDER BY pos)) AS text, count(*) AS n_lines,
         avg({_has('lower(description)', LINES['pharmacy'])}::INT::DOUBLE) AS pharmacy_share, avg({_has('lower(description)', LINES['lab'])}::INT::DOUBLE) AS lab_share,
         count(*) FILTER (pos <= 10 AND lower(trim(description)) IN {_in(TOTALS)}) AS n_totals
  FROM li GROUP BY bill_id
), s AS (
  SELECT *, {', '.join(f"{_score(w)} AS {n}_score" for n, w in SIGNALS.items())} FROM p
), d AS (
  SELECT *, CASE WHEN n_lines >= 3 AND n_totals >= 3 THEN 'hospital_bill' WHEN insurance_score >= 3 THEN 'insurance_document'
    WHEN pharmacy_share >= 0.6 OR (pharmacy_score >= 5 AND pharmacy_share >= 0.4) THEN 'pharmacy_bill' WHEN lab_share >= 0.6 OR (lab_score >= 5 AND lab_share >= 0.4) THEN 'lab_bill'
    WHEN device_score >= 3 THEN 'device_invoice' WHEN hospital_score >= 4 THEN 'hospital_bill'
    WHEN pharmacy_score > hospital_score AND pharmacy_score >= 3 THEN 'pharmacy_bill' WHEN lab_score > hospital_score AND lab_score >= 3 THEN 'lab_bill'
    WHEN hospital_score >= 2 OR n_lines >= 3 THEN 'hospital_bill' ELSE 'unknown' END AS document_type FROM s
)
SELECT bill_id, n_lines, pharmacy_share, lab_share, hospital_score, pharmacy_score, lab_score, device_score, insurance_score, document_type,
       CASE document_type WHEN 'pharmacy_bill' THEN 'pharmacy' WHEN 'lab_bill' THEN 'lab' ELSE 'hospital' END AS analyser FROM d""",
    "episode_split": BRIDGE
    + f""", e AS (SELECT *, {EPISODE_SQL} AS episode FROM li),
p AS (SELECT bill_id, episode, count(*) AS n_lines, sum(amount) AS total, string_agg(description, '; ' ORDER BY pos) AS components FROM e WHERE episode <> 'atomic' GROUP BY ALL)
SELECT bill_id, episode, n_lines, total::DOUBLE AS total, total::DOUBLE * 100 / nullif(bill_total, 0)::DOUBLE AS share_percent, components FROM p LEFT JOIN bills USING (bill_id)""",
    "category_totals": BRIDGE + f"SELECT bill_id, pos, lower(description) || ' - itemization required' AS issue, amount::DOUBLE AS billed, 'low' AS confidence FROM li WHERE lower(trim(description)) IN {_in(TOTALS)} AND amount > 0",
    "atomic_dispatch": BRIDGE + f"SELECT bill_id, {DISPATCH_SQL} AS \"check\", count(*) AS n_lines, sum(amount)::DOUBLE AS amount FROM li WHERE {EPISODE_SQL} = 'atomic' AND amount > 0 GROUP BY ALL",
}

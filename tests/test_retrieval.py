"""Texts found by models and words, contradictions, ceilings, several bills of one upload and dictionaries, on rows worked out by hand."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeaudit.functions import extract as E
from chargeaudit.operators import pricing as P
from chargeaudit.operators import search as S
from chargeaudit.operators import tables as T
from chargeaudit.plans import retrieval as plans
from conftest import DATA


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_say_something(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_embedded_texts(spark):
    texts = [("x", "abc"), ("y", None), ("z", "Éé zZ"), ("w", "")] + [(f"n{i}", "b" * i) for i in range(700)]
    got = {r.id: r.vec for r in S.embedded(spark.createDataFrame(texts, "id string, text string"), "id", S.letter_counts, at_once=64).collect()}
    assert len(got) == 704 and got["x"][:4] == [1, 1, 1, 0] and got["y"] == got["w"] == [0] * 26 and got["z"][25] == 2 and got["n699"][1] == 699
    assert S.embedded(spark.createDataFrame([], "id long, text string"), "id", S.letter_counts).count() == 0


def test_a_model_of_ones_own(spark):
    def load():
        table = {"cat": [1.0, 0.0], "dog": [0.8, 0.6], "car": [0.0, 1.0]}
        return lambda texts: np.array([table.get(t, [0.0, 0.0]) for t in texts])

    q, c = spark.createDataFrame([(1, "cat"), (2, "none")], "query_id long, text string"), spark.createDataFrame([(7, "dog"), (8, "car"), (9, "cat")], "id long, text string")
    assert [(r.query_id, r["rank"], r.id, r.similarity) for r in S.nearest_texts(q, c, 2, load).orderBy("query_id", "rank").collect()] == [(1, 1, 9, 1.0), (1, 2, 7, 0.8)]


@pytest.mark.parametrize("small", [0, 100_000])
def test_found_texts(spark, small):
    words = lambda t: F.split(F.lower(F.coalesce(t, F.lit(""))), " ")
    docs = spark.createDataFrame([(1, "rare common"), (2, "common common"), (3, "common other"), (4, None), (5, "rare")], "id long, text string")
    q = spark.createDataFrame([(1, ["rare", "common"]), (2, ["common"]), (3, ["nothing"]), (4, [])], "query_id long, words array<string>")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in S.found_texts(q, docs, 2, words, small).collect())
    assert got == [(1, 1, 1, 500_000 + 333_333), (1, 2, 5, 500_000), (2, 1, 1, 333_333), (2, 2, 2, 333_333)]
    asked = q.withColumn("keywords", F.col("words"))
    found = S.found_texts(q, docs, 2, words, small)
    assert {r.query_id: (r.recall, r.mean_recall, r.verdict) for r in S.retrieval_quality(asked, docs, found).collect()} == {i: (v, 0.666667, "good") for i, v in ((1, 1.0), (2, 1.0), (3, 0.0))}


def test_contradictions(spark):
    reasons = spark.createDataFrame([(1, "knee brace", 10), (2, "eye test", 5), (3, "", 5), (4, "knee brace", 0), (5, None, 1)], "reason_id long, text string, amount int")
    policies = spark.createDataFrame([(1, "Knee brace is excluded"), (2, "eye test is payable"), (3, "eye surgery is not covered by this test plan of ours")], "id long, text string")
    rules = spark.createDataFrame([(7, "insurers shall cover a knee brace"), (8, "eye test shall cover all")], "id long, text string")
    got = S.contradictions(reasons, policies, rules, ("excluded", "not covered"), ("shall cover",), "claim ").collect()
    assert [tuple(r) for r in got] == [(1, 1, 7, 10.0)]


def test_pharmacy_ceilings(spark):
    rows = [("Aspirin 75 mg", "10", "31.00"), ("Aspirin 75 mg", "10", "33.00"), ("Aspirin 75 mg", "10", "33.01"), ("Aspirin 75 mg", None, "3.40"), ("aspirin tablet strip new 75", "1", "9.00"), ("aspirin 75 mg tablets", "1", "9.00"), ("Total drugs aspirin 75 mg", "1", "900"), ("unlike", "1", "9"), ("Free 1 mg", "1", "9")]
    items = spark.createDataFrame([(1, i, d, "c", Decimal(q) if q else None, Decimal(1), Decimal(a), "") for i, (d, q, a) in enumerate(rows)], "bill_id long, pos int, description string, category string, quantity decimal(12,2), rate decimal(12,2), amount decimal(12,2), batch_no string")
    prices = spark.createDataFrame([("Aspirin 75 mg", Decimal("3.00")), ("Free 1 mg", Decimal(0))], "name string, rate decimal(12,2)")
    got = {r.pos: (r.confidence, r.benchmark, r.similarity) for r in P.pharmacy_ceilings(items, prices).collect()}
    assert got == {2: ("high", 30.0, 1.0), 3: ("high", 3.0, 1.0), 5: ("high", 3.0, 0.866)}
    assert P.pharmacy_ceilings(items, None).count() == 0


def test_consolidated_bills(spark):
    parts = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 3, 3), (2, 1, 1, 9), (3, 1, 1, 1)], "upload_id long, part int, first int, last int")
    lines = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7), (1, 4, 8), (2, 5, 9), (4, 1, 1)], "upload_id long, page int, amount int")
    bills = spark.createDataFrame([(1, 1, "A", "2024-02-01", 11, True), (1, 2, "B", "2024-01-01", 7, False), (2, 1, None, None, None, True), (3, 1, "C", "2024-01-01", 1, None)], "upload_id long, part int, number string, bill_date string, total int, readable boolean")
    tagged, per = T.consolidated(lines, parts, bills)
    assert sorted((r.upload_id, r.source_bill, r.amount) for r in tagged.collect()) == [(1, 1, 5), (1, 1, 6), (2, 1, 9)]
    got = {r.upload_id: tuple(r)[1:] for r in per.collect()}
    assert got == {
        1: (2, 1, 11.0, "2024-02-01", "A", 2, 11.0, "1 of 2 bills could not be read (2); 1 are shown"),
        2: (1, 1, None, None, "?", 1, 9.0, None),
        3: (1, 0, None, None, "", 0, 0.0, "All 1 bills failed"),
    }


def test_consolidated_page_sums(spark):
    """Lines summed by page give what the lines give; the query sorts lines once, before pages are stored."""
    parts = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 3, 3), (2, 1, 1, 9)], "upload_id long, part int, first int, last int")
    lines = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, None), (1, 3, 7), (2, 5, None)], "upload_id long, page int, amount int")
    bills = spark.createDataFrame([(1, 1, "A", "2024-02-01", 11, True), (1, 2, "B", "2024-01-01", 7, False), (2, 1, "C", None, None, True)], "upload_id long, part int, number string, bill_date string, total int, readable boolean")
    sums = lines.groupBy("upload_id", "page").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    got = {r.upload_id: tuple(r)[1:] for r in T.consolidated(sums, parts, bills, number="n")[1].collect()}
    assert got == {r.upload_id: tuple(r)[1:] for r in T.consolidated(lines, parts, bills)[1].collect()}
    assert {k: r[5:7] for k, r in got.items()} == {1: (3, 11.0), 2: (1, 0.0)}
    assert "l_orderkey" not in plans.multi_bill_consolidated(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_dictionary_is_the_fold(spark):
    """A table of 214 entries gives what the fold over a list of them gives, whatever the entries hold."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    keys = list(dict.fromkeys([*(rng.choice([" ", "/", "-", " & "]).join(word() for _ in range(rng.randint(1, 3))) for _ in range(400)), "na/k", "ca 19-9", "urine c&s"]))[-214:]
    dictionary = {k: [f"{k.upper()} {i}" for i in range(rng.randint(1, 3))] for k in keys}
    terms = [rng.choice([" ", "/", "-", ", "]).join(word() for _ in range(rng.randint(1, 7))) + rng.choice(["", " 12", " (x y)", " - Dr. Who", " - 3"]) for _ in range(400)] + [*map(str.title, keys[:20]), "", "  ", "(only)", "ABC é ß İ", None]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(dictionary.items())] + [(None, ["x"], 0), ("", ["y"], 0), (keys[0], ["later"], 999)], "abbreviation string, expansions array<string>, place int")
    got = {r.term: r for r in E.expanded_by(df, table).collect()}
    want = {r.term: r.expanded for r in E.expanded(df.filter("term IS NOT NULL"), dictionary).collect()}
    assert {k: r.expanded for k, r in got.items() if k is not None} == want and got[None].expanded is None
    assert any(len(r.matched) > 2 for r in got.values()) and all(r.n_expansions == len({w for k in r.matched for w in dictionary[k]}) for r in got.values())
    with pytest.raises(ValueError):
        E.expanded_by(df, table, most=10)
    assert {r.expanded for r in E.expanded_by(df, table.limit(0)).filter("term = 'na/k'").collect()} <= {"na/k"}

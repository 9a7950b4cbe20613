"""Matching of texts against a comparison of all pairs, and the time that a common word takes."""

from __future__ import annotations

import random
import re
import time
from decimal import ROUND_HALF_UP, Decimal

import pytest

from chargeaudit.operators import matching as M


def brute(texts, names, n, least):
    words = lambda t: {w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w}
    out = []
    for t in set(texts):
        found = []
        for name, rate in set(names):
            if shared := len(words(t) & words(name)):
                s = float(Decimal(repr(shared / (float(len(words(t))) * len(words(name))) ** 0.5)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
                if s >= least:
                    found.append((-s, name, rate))
        out += [(t, i + 1, name, rate, -s) for i, (s, name, rate) in enumerate(sorted(found)[:n])]
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 3, 64])
@pytest.mark.parametrize("n, least", [(1, 0.0), (3, 0.0), (1, 0.45), (5, 0.65), (2, 1.0)])
def test_against_all_pairs(spark, hot, n, least):
    rng = random.Random(n * 7 + hot)
    vocabulary = ["charges", "ward", *[f"w{i}" for i in range(25)]]
    line = lambda: " ".join(["charges"] * rng.randint(0, 1) + [rng.choice(vocabulary[: rng.choice([3, 10, 27])]) for _ in range(rng.randint(0, 5))])
    texts, names = [line() for _ in range(60)] + [None, "", "unknown words", "Charges, WARD"], [(line(), rng.randint(1, 3)) for _ in range(80)] + [("charges", 1), (None, 2)]
    t, b = spark.createDataFrame([(x,) for x in texts + texts[:5]], "text string"), spark.createDataFrame(names + names[:4], "name string, rate int")
    got = sorted((r.text, r["rank"], r.name, r.rate, r.similarity) for r in M.text_matches(t, b, n, least, ("rate",), hot).collect())
    assert got == brute([x for x in texts if x], [x for x in names if x[0]], n, least)


def test_empty_tables(spark):
    t, b = spark.createDataFrame([("a b",)], "text string"), spark.createDataFrame([("a",)], "name string")
    assert M.text_matches(t.limit(0), b).count() == 0 and M.text_matches(t, b.limit(0)).count() == 0


def test_a_common_word_makes_no_pairs(spark):
    """20,000 texts and 20,000 names that all share a word would be 400 million pairs."""
    t = spark.range(20_000).selectExpr("concat('charges for item', id, ' of ward', id % 700) AS text")
    b = spark.range(20_000).selectExpr("concat('charges item', id, ' unit') AS name")
    began = time.perf_counter()
    got = {r.text: (r.name, r.similarity) for r in M.text_matches(t, b).collect()}
    assert len(got) == 20_000 and got["charges for item77 of ward77"] == ("charges item77 unit", 0.5164)
    assert time.perf_counter() - began < 60


def test_lines_are_not_dealt_by_text_or_missing_code(spark):
    """Lines without a code are spread by what they hold, lines of one text are not brought together, and null texts stay without a match."""
    prices = spark.createDataFrame([(1, "red rod", Decimal("5.00")), (2, "old ring", Decimal("7.00")), (None, "blue rod", Decimal("1.00"))], "code long, name string, rate decimal(12,2)")
    rows = [(i, 1, "rod red" if i % 3 else None, 2 if i % 4 == 0 else None if i % 2 else 9) for i in range(40)]
    items = spark.createDataFrame(rows, "bill_id long, pos int, description string, code long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.code_or_text(items, prices)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_deal" in plan and "hashpartitioning(description" not in plan
        got = {r.bill_id: (r.matched, r.similarity) for r in out.collect()}
        best = M.best_of_texts(items.withColumn("other", M.F.when(M.F.col("bill_id") < 20, "ring old")), prices, ("other", "description"))
        assert "Window" not in best._jdf.queryExecution().executedPlan().toString()
        best = sorted((r.bill_id, r.source, r.text, r.name) for r in best.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: ("old ring", 1.0) if c == 2 else ("red rod", 1.0) if t else (None, None) for i, _, t, c in rows}
    assert best == [(i, 0, "ring old", "old ring") if i < 20 else (i, 1, "rod red", "red rod") for i, _, t, _ in rows if i < 20 or t]

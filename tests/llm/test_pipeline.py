"""The pipeline against a version that works in memory, stage by stage."""

from __future__ import annotations

from collections import Counter

import pyarrow.dataset as ds
from conftest import DATA, oracle
from test_text_operators import SCHEMA, components, corpus

import corpus_pipeline
from chargeaudit.llm import mixing, quality_rules, secret_scan
from chargeaudit.llm.common import table, written


def test_stages(spark):
    docs, kept = table(spark, DATA, "documents"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, DATA), "stage")
        kept[name] = docs
        if i < 4:
            assert docs.columns == columns
        rows = before.toPandas()
        if name == "quality rules":
            judged = oracle(quality_rules.ORACLE)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(judged.doc_id[judged.kept])
        elif name == "near-duplicates":
            want = components(zip(rows.doc_id, rows.text, strict=True))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, c in want.items() if i == c)
        elif name == "secret scans":
            spans = oracle(secret_scan.ORACLE_SQL["op8_secret_scan"], documents=rows).set_index("doc_id").spans
            after = docs.toPandas().set_index("doc_id").text
            for i, t in zip(rows.doc_id, rows.text, strict=True):
                assert (after[i] == t) == (spans[i] == "")
                assert all(t[int(s.split(":")[1]) : int(s.split(":")[2])] not in after[i] for s in spans[i].split(",") if s)
        elif name == "mixing":
            taken = oracle(mixing.ORACLE, documents=rows).set_index("doc_id")
            times = Counter(r.doc_id for r in docs.collect())
            for i, r in taken.iterrows():
                assert r.taken // max(r["size"], 1) <= times[i] <= -(-r.taken // max(r["size"], 1)) and times[i] <= 2
    packed = docs.toPandas()
    times = Counter(kept["mixing"].toPandas().doc_id)
    assert {i: n for i, n in packed.groupby("doc_id").length.sum().items()} == {i: n * times[i] for i, n in packed.groupby("doc_id").doc_tokens.first().items()}


def test_stages_on_hard_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and an empty table pass all stages."""
    docs = spark.createDataFrame(corpus(), SCHEMA).drop("kept", "n_words")
    rows = [(None, "some words of no document " * 6, None, None, None), (7, None, "en", "a", 1), (7, " ".join(f"w{i}" for i in range(30_000)), "en", "a", 1), (7, " ".join(f"v{i}" for i in range(60)) + " token=abcdef123", "en", "a", 1)]
    docs = docs.union(spark.createDataFrame([*rows, rows[2]], docs.schema)).repartition(2)
    for start in (docs, docs.limit(0)):
        out = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, out = out, written(stage(spark, out, DATA), "stage")
            assert i == 4 or out.columns == docs.columns
            if i == 1 and start is docs:
                assert sorted((r.doc_id, r.text) for r in out.filter("doc_id = 7").collect()) == sorted({(r.doc_id, r.text) for r in before.filter("doc_id = 7").collect()})
            if i == 2:
                assert out.filter("text LIKE '%abcdef123%'").count() == 0
        assert (out.count() > 0) == (start is docs)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert ds.dataset(f"{DATA}/documents.parquet").count_rows() > 0

"""Stored tables: rows that break their rules, refreshes under a reader, counts of one pass, chunk files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chargeaudit.operators import matching as M
from chargeaudit.sources import catalog as C
from chargeaudit.sources import files as S
from chargeaudit.sources.bridge import stored


def test_rows_that_break_rules(spark):
    rows = [
        ("1", "u", None, "12.345", "x"), ("1", "v", "failed", "1", "x"), (None, "u", "complete", None, "x"), ("2", None, "complete", "1", "x"), ("3", "u", "lost", "a lot", "x"), ("3", "u", "failed", "1", "x"), ("4", "", "", "99999999999", "x"),
    ]
    good, bad = C.admitted(spark.createDataFrame(rows, "id string, user_id string, status string, bill_total string, `a.b` string"), C.TABLES["analyses"], order=("user_id",))
    assert good.columns == list(C.TABLES["analyses"].columns) and bad.columns == [*good.columns, "reasons"]
    taken = sorted((r.user_id, r.status, str(r.bill_total), r.created_at is not None) for r in good.collect())
    assert taken == [("u", "complete", "None", True), ("u", "failed", "1.00", True), ("u", "processing", "12.35", True)]
    assert sorted((r.id, tuple(r.reasons)) for r in bad.collect()) == [
        ("1", ("id is there already",)), ("2", ("user_id is missing",)), ("3", ("bill_total is no decimal(12,2)", "status is none of the allowed")), ("4", ("bill_total is no decimal(12,2)", "status is none of the allowed")),
    ]
    none = C.admitted(spark.createDataFrame([], "id string"), C.TABLES["analyses"])
    assert [df.count() for df in none] == [0, 0]


def test_parents_and_unique_columns(spark):
    docs = spark.createDataFrame([("a", "1", "bill", "/f"), ("b", "9", "bill", "/f"), ("c", None, "photo", None)], "id string, analysis_id string, doc_type string, file_path string")
    parents = {"analyses": spark.createDataFrame([("1",), ("1",), (None,)], "id string")}
    good, bad = C.admitted(docs, C.TABLES["documents"], parents)
    assert [r.id for r in good.collect()] == ["a"]
    assert {r.id: tuple(r.reasons) for r in bad.collect()} == {"b": ("analysis_id has no row in analyses",), "c": ("analysis_id is missing", "file_path is missing", "doc_type is none of the allowed")}
    rules = spark.createDataFrame([("x", "R1", 2), ("y", "R1", 1), ("z", "R2", 3)], "id string, regulation_name string, n int")
    good, bad = C.admitted(rules, C.TABLES["regulation_cache"], order=("n",))
    assert sorted((r.id, r.is_current) for r in good.collect()) == [("y", True), ("z", True)] and [tuple(r.reasons) for r in bad.collect()] == [("regulation_name is there already",)]


@pytest.mark.parametrize("name", sorted(C.TABLES))
def test_tables_can_be_created(spark, name):
    t = C.TABLES[name]
    assert {*t.key, *t.required, *t.unique, *t.allowed, *t.defaults, *(c for c, _ in t.parents)} <= set(t.columns) and {n for _, n in t.parents} <= set(C.TABLES)
    ddl = ", ".join(f"`{c}` {k}" for c, k in t.columns.items())
    assert C.admitted(spark.createDataFrame([], ddl), t)[0].schema.fieldNames() == list(t.columns)


def test_reader_sees_old_or_new(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        C.current(spark, path)
    C.refreshed(spark.range(10).withColumn("type", F.lit("a")), path, ("type",))
    reader = C.current(spark, path)
    spark.range(3).write.parquet(f"{path}/v-half")  # a refresh that never came to its end
    assert C.current(spark, path).count() == 10
    second = C.refreshed(spark.range(20).withColumn("type", F.lit("b")), path, ("type",))
    assert reader.count() == 10 and C.current(spark, path).count() == 20 and C.current_version(spark, path) == second
    assert C.tidied(spark, path) == 2 and C.current(spark, path).filter("type = 'b'").count() == 20


def test_counts_of_one_pass(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "id int, price double")
    kept, n = M.kept_while_stored(rows, F.col("price") > 0, lambda df: stored(df, "kept"))
    assert n == {"n_kept": 1, "n_dropped": 2} and [r.id for r in kept.collect()] == [1]
    seen = []
    M.kept_while_stored(spark.range(5), F.col("id") > 1, lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, "kept"))
    assert seen[0].count("Range") == 1 and "CollectMetrics" in seen[0]


def test_chunk_files(spark, tmp_path):
    rows = [("c2", "two", "s", None, "d", 3, 2, None, ["15 days", "1 hour"], []), ("c1", "one é", "s", None, "d", 3, 1, "", [], ["claim"]), ("x", "other", "t", "r", "d", 1, 1, "A", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, source string, reference string, date string, total_pages int, page int, section string, timelines array<string>, key_terms array<string>")
    S.write_chunks(df, str(tmp_path / "c"))
    got = {r.chunk_id: (r.text, r.metadata) for r in S.read_chunks(spark, str(tmp_path / "c")).collect()}
    assert got["c2"] == ("two", {"source": "s", "date": "d", "page": "2", "timelines": "15 days, 1 hour", "chunk_chars": "3"})
    assert got["c1"] == ("one é", {"source": "s", "date": "d", "page": "1", "section": "", "key_terms": "claim", "chunk_chars": "5"}) and len(got) == 3
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.json").write_text('{"chunks": [{"chunk_id": "k",\n "text": "t"}]}')
    (tmp_path / "broken" / "b.json").write_text("{no json")
    assert [r.chunk_id for r in S.read_chunks(spark, str(tmp_path / "broken"), whole=True).collect()] == ["k"]

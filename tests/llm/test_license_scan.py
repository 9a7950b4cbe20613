"""License scans against SQL, and the parser against Python's own evaluation of random expressions."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from conftest import DATA, agree

from chargeaudit.llm import license_scan
from chargeaudit.llm.license_scan import evaluated

TAG = "SPDX-License-Identifier: "
TEXTS = [
    None,
    "",
    " \n\t",
    "Licensed under the Apache License, version 2.0.",
    "The GNU\nGeneral-Public   LICENSE; gnu general public license. CC BY-NC 4.0 and cc by",
    "apache licenses, an apachelicense, Apache Licénse, apache 2 license",
    "cc by cc by cc by sa\x00mit\x7flicense",
    "müller mit license ÀÉ MIT LICENSE",
    f"// {TAG}MIT\nx = 1",
    f"/* {TAG}(GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND BSD-3-Clause */",
    f"{TAG}GPL-2.0-only WITH Classpath-exception-2.0",
    f"{TAG}LGPL-2.1+ with and",
    f"{TAG}MIT OR\n{TAG}MIT AND (ISC\n{TAG}MIT) OR (ISC",
    f"{TAG}mpl-2.0 and gpl-3.0 or isc\n{TAG}Foo-1.0 or cc0-1.0",
    f"{TAG}(MIT OR GPL-2.0) WITH x",
    f"{TAG}MIT ISC",
    f"{TAG}() MIT",
    f"{TAG}\nLicense-Expression: ((Apache-2.0))\nspdx license identifier: mit",
    f"<!-- {TAG}CC-BY-NC-4.0 or Foo -->  all rights reserved",
    "permission is hereby granted, free of charge, to any person",
    "word " * 60_000 + "mit license " + "word " * 60_000,
    "x" * 2_000_000 + " mit license",
    "İK ſ mit License",
]


def frame() -> pd.DataFrame:
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, "mit license"), (None, "cc by")]
    return pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if pd.isna(i) else int(i), t, "clash", 1) for i, t in frame().itertuples(index=False)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, score int").repartition(3)


def test_fixture(docs):
    agree(license_scan.license_scan(docs), license_scan.ORACLE_SQL["op12_license_scan"], None, documents=frame())


def test_tables(spark):
    agree(license_scan.op12_license_scan(spark, DATA), license_scan.ORACLE_SQL["op12_license_scan"])


def test_empty_table(docs):
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_places_and_labels(docs):
    rows = {r.doc_id: r for r in license_scan.license_scan(docs.filter("doc_id IN (4, 9, 10, 12, 18)")).collect()}
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word, rows[4].base_labels, rows[4].labels, rows[4].score) == (4, 1, 15, "cc-by,gpl", "cc-by,cc-by-nc,gpl", 0.25)
    assert (rows[9].labels, rows[9].score) == ("bsd,gpl,mit", 1.0)
    assert (rows[10].labels, rows[10].score) == ("gpl", 0.75)
    assert (rows[12].labels, rows[12].score) == ("", 0.0)
    assert (rows[18].labels, rows[18].score) == ("cc-by,cc-by-nc,other,reserved", 0.25)


def test_parser_against_python():
    """Python's precedence of ``and`` over ``or`` on numbers is that of & over |, taken as min and max."""

    class Value(int):
        def __and__(self, other):
            return Value(min(int(self), int(other)))

        def __or__(self, other):
            return Value(max(int(self), int(other)))

    rng, ids = random.Random(5), {"MIT": 4, "GPL-3.0": 2, "LGPL-2.1+": 3, "Foo": 1, "GPL-2.0 WITH Classpath-exception-2.0": 3}

    def expression(depth: int) -> str:
        if not depth or rng.random() < 0.3:
            return rng.choice(list(ids))
        parts = [expression(depth - 1) for _ in range(rng.randint(2, 3))]
        text = parts[0] + "".join(f" {rng.choice(['AND', 'or', 'OR', 'and'])} {p}" for p in parts[1:])
        return f"({text})" if rng.random() < 0.6 else text

    for _ in range(300):
        text = expression(4)
        code = text
        for name in sorted(ids, key=len, reverse=True):
            code = code.replace(name, f"Value({ids[name]})")
        for word, sign in (("AND", "&"), ("and", "&"), ("OR", "|"), ("or", "|")):
            code = code.replace(f" {word} ", f" {sign} ")
        assert evaluated(text)[1] == int(eval(code, {"Value": Value})), text


@pytest.mark.parametrize("text", ["", "and", "MIT and", "or MIT", "MIT MIT", "(MIT", "MIT)", "()", "MIT WITH", "(MIT) WITH x", "MIT WITH x WITH y", "MIT WITH (x)", "MIT & ISC", "é"])
def test_no_expression(text):
    assert evaluated(text) is None


def test_deep_brackets():
    assert evaluated("(" * 50_000 + "MIT" + ")" * 50_000) == (frozenset(["mit"]), 4)

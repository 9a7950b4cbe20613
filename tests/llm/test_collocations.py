"""Collocations against SQL over fixtures and tables; filters as exact round trips."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, agree

from chargeaudit.llm import collocations
from chargeaudit.llm.collocations import packed_filter, permuted, restored, summed, unpacked_filter

SQL = collocations.ORACLE_SQL["op11_collocations"]


def rows() -> list[tuple]:
    rng = random.Random(6)
    vocabulary = ["The", "of", "new", "york", "CITY", "stock", "exchange", "é", "日本", "\x01", "a b", "x-y", "#"]
    out: list[tuple] = [(None, None), ("en", None), ("en", ""), (None, "..!?"), ("und", " \t\n\x0b\x0c\r"), ("de", "only a few words")]
    for i in range(260):
        line = [rng.choice(vocabulary[: 4 + i % 10]) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " New York Stock Exchange ", " of the "]) for w in line)
        out.append((["en", None, "de", "und", "ﬁ"][i % 5], text))
    out += [("fr", "spam " * 5000), ("fr", "a b c d " * 40), ("fr", "a b c d e. " * 30), ("en", "w" * 300_000 + " x")]
    return out + out[6:20]


def frame() -> pd.DataFrame:
    return pd.DataFrame(rows(), columns=["lang", "text"])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows()], "lang string, text string, phrase string, n int, id int").repartition(5)


def test_fixture(docs):
    agree(collocations.collocations(docs), SQL, None, documents=frame())


def test_own_ids_and_many_filters(docs, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "SHARD", 500)
    agree(collocations.collocations(docs, most_words=3), SQL, None, documents=frame())


def test_tables(spark):
    agree(collocations.op11_collocations(spark, DATA), SQL)


def test_top(docs):
    few = SQL.replace("rank <= 2000", "rank <= 3")
    agree(collocations.collocations(docs, top=3), few, None, documents=frame())


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("bits", [2, 6, 20, 32, 34, 50, 64])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    most = 1 << bits
    draw = lambda: np.array([int(x) % most for x in rng.integers(0, 1 << 62, 3000)], np.uint64)
    hi, lo = draw(), draw()
    if bits <= 6:
        assert len({*zip(*(x.tolist() for x in permuted(*np.divmod(np.arange(most * most, dtype=np.uint64), np.uint64(most)), bits)), strict=True)}) == most * most
    a, b = permuted(hi, lo, bits)
    assert all((x == y).all() for x, y in zip(restored(a, b, bits), (hi, lo), strict=True))
    n = rng.choice([1, 2, 254, 255, 256, 1 << 40], 3000)
    want: Counter = Counter()
    for key in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        want[key[:2]] += key[2]
    for shard_bits in {0, 1, bits // 2, min(bits, 16)}:
        shards: dict[int, list] = {}
        for part in np.array_split(np.arange(3000), 4):
            one = summed([(a[part], b[part], n[part])], bits)
            at = (one[0] >> np.uint64(bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(one[0]), np.int64)
            for s in np.unique(at).tolist():
                raw = packed_filter(tuple(x[at == s] for x in one), bits, shard_bits)
                shards.setdefault(s, []).append(unpacked_filter(raw, s, bits, shard_bits))
        got = {}
        for parts in shards.values():
            x, y, z = summed(parts, bits)
            pairs = list(zip(x.tolist(), y.tolist(), strict=True))
            assert pairs == sorted(pairs)
            got |= dict(zip(pairs, z.tolist(), strict=True))
        assert got == want


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    one = summed([(*permuted(rng.integers(0, 1 << 32, 100_000).astype(np.uint64), rng.integers(0, 1 << 32, 100_000).astype(np.uint64), 32), np.ones(100_000, np.int64))], 32)
    assert len(packed_filter(one, 32, 0)) < 9 * 100_000


def test_scores_beyond_64_bits(spark):
    big = 1 << 53
    rows = [(1, "en", big, ["a", "b"], [big, 3 * big]), (2, "en", big - 1, ["a", "b", "c"], [big, 3 * big, big]), (3, "en", big, ["b", "c"], [3 * big, big])]
    found = collocations.scored(spark.createDataFrame(rows, "_g long, lang string, a long, words array<string>, ones array<long>"))
    got = {r.phrase: (r.l, r.r, r.score) for r in found.collect()}
    assert got == {"a b": (big, 3 * big, 2_000_000 * big // (4 * big)), "b c": (3 * big, big, 500_000), "a b c": (big, big, 2_000_000 * (big - 1) // (2 * big))}
    assert {r.phrase for r in collocations.not_covered(found).collect()} == {"a b c"}

"""Token alignment against a version that compares all byte ranges of a document and counts pairs in plain dictionaries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chargeaudit.llm import token_alignment
from chargeaudit.llm.token_alignment import Tokenizers, parts

TEXTS = [
    None,
    "",
    " ",
    "one",
    "  two  spaces\n\tand tabs \r\n",
    "Naïve café — “quotes” 日本語 مرحبا 😀😀 \u00a0 x",
    "a<|endoftext|>b <s> </s> <unk> <0x41>",
    "a sign \u2581 of its own",
    "internationalisation antidisestablishmentarianism 1234567890",
    "\x00\x01 control",
    "the the the the",
    "e\u0301 combining, and ½ ² Ⅳ",
]


def brute(rows: list[tuple]) -> list[tuple]:
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in own} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    docs, pairs = [], Counter()
    for doc_id, text in rows:
        whole = f" {text}".encode() if text else b""
        one, two = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        first = [bytes(letters[c] for c in a.id_to_token(i)) for i in one]
        second = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in two]
        if not text or b"".join(first) != whole or b"".join(second) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, tokens in ((one, first), (two, second)):
            at, out = 0, []
            for i, t in zip(ids, tokens, strict=True):
                out.append((at, at + len(t), i))
                at += len(t)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = ["|".join(",".join(str(x[2]) for x in s if p < x[1] <= q) for s in spans) for p, q in zip([0, *ends], ends, strict=False)]
        pairs.update(links)
        docs.append((doc_id, one, two, links, groups))
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (str(doc_id), len(one), len(two), len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if one else "")
        for doc_id, one, two, links, groups in docs
    ]


def got(df) -> list[tuple]:
    return sorted((str(r.doc_id), *r[1:]) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def rows() -> list[tuple]:
    rng = random.Random(2)
    made = ["".join(rng.choice("ab é  \n▁日<>|0x.,T'sll") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [(i, t) for i, t in enumerate([*TEXTS, *made])] + [(3, "one"), (None, "null id"), (10, "the the the the")]


@pytest.mark.parametrize("common", [0, 20, 50_000])
def test_against_brute_force(spark, common):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "doc_id long, text string, pairs string, n_best int").repartition(3)
    assert got(token_alignment.alignment(docs, common=common)) == sorted(brute(rows()))


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.length("text") < 6000)
    assert got(token_alignment.alignment(docs)) == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_empty_table(spark):
    assert token_alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_are_encoded_as_the_whole():
    by, rng = Tokenizers(None, None, None), random.Random(4)
    texts = ["".join(rng.choice(["the", "é", " ", " ", "  ", "\n", "ab", "'s", "<s>", "日本", "12", ".", "\u2581", "\u00a0"]) for _ in range(800)) for _ in range(30)]
    for t in texts:
        cut = parts(t, 40)
        assert "".join(cut) == t and len(cut) > 5
        whole_a, whole_b = by.a.encode(f" {t}", add_special_tokens=False).ids, by.b.encode(t)
        assert [i for k, x in enumerate(cut) for i in by.a.encode(x if k else f" {x}", add_special_tokens=False).ids] == whole_a
        assert [i for k, x in enumerate(cut) for i in by.b.encode(x[1:] if k else x)] == whole_b


def test_no_piece_holds_a_space_behind_another_character():
    by = Tokenizers(None, None, None)
    for pieces in (by.a_bytes, by.b_bytes):  # white space aside, where no text is cut
        assert not [p for p in pieces if b" " in p.lstrip(b" \t\n\r\x0b\x0c\xc2\xa0")]


def test_long_texts(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(80_000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 300_000), (3, " " * 50_000)], "doc_id long, text string")
    by = Tokenizers(None, None, None)
    for r in token_alignment.alignment(docs).collect():
        text = {1: long, 2: "x" * 300_000, 3: " " * 50_000}[r.doc_id]
        assert (r.n_a, r.n_b) == (len(by.a.encode(f" {text}", add_special_tokens=False).ids), len(by.b.encode(text)))
        assert r.n_groups > 0 and r.n_links >= max(r.n_a, r.n_b)


def test_ranks_give_the_ids_of_the_vocabulary():
    """Plain texts go by ranks, all others by the tokenizer itself."""
    by, rng = Tokenizers(None, None, None), random.Random(1)
    plain = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x250)]]
    for _ in range(5000):
        text = "".join(rng.choice(plain) if rng.random() < 0.5 else rng.choice(" abc'sdlveETHE19 \n") for _ in range(rng.randint(1, 50)))
        assert token_alignment.PLAIN.fullmatch(text)
        assert by.encode_a(text) == by.a.encode(text, add_special_tokens=False).ids
    assert token_alignment.PLAIN.fullmatch("日本") is None

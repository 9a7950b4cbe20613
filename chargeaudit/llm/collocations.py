"""Phrase collocations counted in quotient filters: per language, the phrases of two to four words that belong together.

1. Words are counted per language.  A phrase is never more frequent than one of its words, so only words with ``least``
   occurrences get an id; ids are dense and belong to one language each, and all other words end a run like a sign does.
2. A task packs the ids of two to four words that follow each other into one number, zeros behind them, in two halves of
   as many bits as two ids have.  A Feistel network over the halves permutes these numbers: it can be undone, so it loses nothing,
   and what it gives is spread evenly.  A counting quotient filter keeps the permuted numbers in order: the first bits,
   the quotient, only as the length of the run that each of them has, the rest in full, and a counter of one byte that overflows into a list.
   A task's filter is cut by the first bits into shards and sent to them when it holds HELD numbers.
3. Filters of one shard are merged in order and counters are added; numbers that reach ``least`` are permuted back into ids.
   There are so many shards that what a shard can hold is bounded, whatever the size of the corpus or of a language.
4. Candidates get their words back by a join, and their parts' counts by joins on the candidates themselves: a part of a candidate is at
   least as frequent, so it is a candidate or a word with an id.  Scores are whole numbers, divided as decimals.
5. The best of each language are taken in two steps, from salted parts first, since a language may hold most candidates.

A dictionary of at most ``most_words`` words is sent to the workers.  Beyond that each document gets its own words' ids by a join.

Defined cases: a null or empty text has no word; a null lang is ``und`` and counts with texts of that lang; long texts and
long words have no bound, a text's words are held once; repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import has_columns, join_small, mixed, slices, table, texts_of, written

LEAST = 30
TOP = 2000
LONGEST = 4
#: A longer candidate takes a shorter one's place if it has so many hundredths of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Words of a dictionary that is sent to the workers.
WORDS = 200_000
#: Numbers in a task's filter, and occurrences of phrases for each shard.
HELD = 1 << 20
SHARD = 1 << 21
MOST_SHARD_BITS = 16
#: Parts in which the best of a language are looked for first.
SALTS = 32
#: A sign that ends a piece; no word holds it.
STOP = b"."

_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"." * 10 + b" ")


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, with STOP between pieces."""
    return text.lower().translate(_PIECES).replace(STOP, b" . ").split()


# --- words ---


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n of all words, summed by task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[bytes]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                counts.pop(STOP, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
            found.clear()

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text or b""))
            if sum(map(len, found.values())) > HELD // 4:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """id, lang, word and n of the frequent words; ids begin with 1 and have few gaps, for they are dealt around partitions."""
    found = counts.filter(F.col("n") >= least)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return written(found.repartition(parts, "lang", "word").select((turn * parts + F.spark_partition_id() + 1).alias("id"), "lang", "word", "n"), "dictionary")


def with_own_ids(docs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, text and the ids of a text's own words."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for row, lang, text in zip(batch.column("_row").to_pylist(), batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True):
                own = sorted({*words_of(text or b"")} - {STOP})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string())], names=["_row", "lang", "word"])

    told = rows.mapInArrow(work, "_row long, lang string, word string").join(words.select("lang", "word", "id").hint("merge"), ["lang", "word"])
    own = told.groupBy(F.col("_row").alias("_r")).agg(F.collect_list(F.struct("word", "id")).alias("ids"))
    return rows.join(own.hint("merge"), F.col("_row") == F.col("_r"), "left").select("lang", "text", "ids")


# --- filters ---


def permuted(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network over two halves of ``bits`` bits."""
    mask = np.uint64((1 << bits) - 1)
    for turn in range(2):
        hi = hi ^ (mixed(lo + np.uint64(2 * turn + 1)) & mask)
        lo = lo ^ (mixed(hi + np.uint64(2 * turn + 2)) & mask)
    return hi, lo


def restored(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permuted``."""
    mask = np.uint64((1 << bits) - 1)
    for turn in (1, 0):
        lo = lo ^ (mixed(hi + np.uint64(2 * turn + 2)) & mask)
        hi = hi ^ (mixed(lo + np.uint64(2 * turn + 1)) & mask)
    return hi, lo


Sorted = tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(parts: list[Sorted], bits: int) -> Sorted:
    """Sorted numbers (two halves) and their counts, of several such lists."""
    hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if 2 * bits <= 64:
        key = hi << np.uint64(bits) | lo
        order = np.argsort(key, kind="stable")  # merges lists that are in order
        new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    else:
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        new = np.flatnonzero((np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0))
    first = order[new]
    return hi[first], lo[first], np.add.reduceat(n[order], new) if len(new) else n[:0]


HEAD = struct.Struct("<QBBQ")


def packed_filter(found: Sorted, bits: int, shard_bits: int) -> bytes:
    """The quotient filter of one shard's sorted numbers."""
    hi, lo, n = found
    q = min(max(len(hi).bit_length() - 1, 0), bits - shard_bits)
    left = bits - shard_bits - q
    quotient = (hi >> np.uint64(left)).astype(np.int64) & ((1 << q) - 1)
    runs = np.bincount(quotient, minlength=1 << q)
    wide = bool(runs.max(initial=0) > 255)
    low = lambda x, width: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    many = n[n >= 255]
    return b"".join(
        (
            HEAD.pack(len(hi), q, wide, len(many)),
            runs.astype("<u8" if wide else "u1").tobytes(),
            low(hi & np.uint64((1 << left) - 1), -(-left // 8)),
            low(lo, -(-bits // 8)),
            np.minimum(n, 255).astype("u1").tobytes(),
            many.astype("<u8").tobytes(),
        )
    )


def unpacked_filter(raw: bytes, shard: int, bits: int, shard_bits: int) -> Sorted:
    """The sorted numbers and counts of a filter."""
    m, q, wide, many = HEAD.unpack_from(raw)
    left = bits - shard_bits - q
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    def wider(width: int) -> np.ndarray:
        out = np.zeros((m, 8), np.uint8)
        out[:, :width] = take("u1", m * width).reshape(m, width)
        return out.view("<u8").ravel().astype(np.uint64)

    runs = take("<u8" if wide else "u1", 1 << q).astype(np.int64)
    hi = wider(-(-left // 8)) | np.repeat(np.arange(1 << q, dtype=np.uint64), runs) << np.uint64(left) | np.uint64(shard << (bits - shard_bits))
    lo = wider(-(-bits // 8))
    n = take("u1", m).astype(np.int64)
    n[n == 255] = take("<u8", many)
    return hi, lo, n


def grams(ids: np.ndarray, bits: int) -> Sorted:
    """Permuted numbers of all phrases in a line of ids, in which 0 ends a run."""
    half = np.uint64(bits // 2)
    x = np.concatenate([ids.astype(np.uint64), np.zeros(LONGEST - 1, np.uint64)])
    a, b, c, d = (x[k : len(ids) + k] for k in range(LONGEST))
    two = np.flatnonzero((a != 0) & (b != 0))
    three = two[c[two] != 0]
    four = three[d[three] != 0]
    hi = a << half | b
    none = lambda at: np.zeros(len(at), np.uint64)
    his = np.concatenate([hi[two], hi[three], hi[four]])
    los = np.concatenate([none(two), c[three] << half, c[four] << half | d[four]])
    return *permuted(his, los, bits), np.ones(len(his), np.int64)


def filters(docs: DataFrame, ids, bits: int, shard_bits: int) -> DataFrame:
    """shard and filter, several of each shard; ``ids``: the broadcast dictionary by lang, or None where rows have their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Sorted] = []

        def rows() -> pa.RecordBatch:
            hi, lo, n = summed(held, bits)
            held.clear()
            shard = (hi >> np.uint64(bits - shard_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            each = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(hi)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int64()), pa.array([packed_filter((hi[s], lo[s], n[s]), bits, shard_bits) for s in each], pa.binary())], names=["shard", "filter"])

        for batch in slices(batches, "text", 1 << 20):
            line: list[np.ndarray] = []
            for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True)):
                words = words_of(text or b"")
                known = ids.value.get(lang, {}) if ids is not None else {x["word"].encode(): x["id"] for x in batch.column("ids")[i].as_py() or ()}
                line += [np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
            new = grams(np.concatenate(line), bits)
            if len(new[0]):
                held.append(summed([new], bits))
            if len(held) > 1 and len(held[-1][0]) >= len(held[-2][0]) // 4:
                held[:] = [summed(held, bits)]
            if sum(len(x[0]) for x in held) > HELD:
                yield rows()
        if held:
            yield rows()

    return docs.mapInArrow(work, "shard long, filter binary")


def merged(found: DataFrame, least: int, bits: int, shard_bits: int) -> DataFrame:
    """ids and a of the phrases that reach ``least``, from all filters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Sorted] = []
        now = None

        def rows() -> pa.RecordBatch:
            hi, lo, n = summed(held, bits)
            held.clear()
            often = n >= least
            hi, lo = restored(hi[often], lo[often], bits)
            half, mask = np.uint64(bits // 2), np.uint64((1 << bits // 2) - 1)
            ids = np.stack([hi >> half, hi & mask, lo >> half, lo & mask], axis=1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.list_(pa.int64())), pa.array(n[often])], names=["ids", "a"])

        for batch in slices(batches, "filter"):
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("filter").to_pylist(), strict=True):
                if shard != now and held:
                    yield rows()
                now = shard
                held.append(unpacked_filter(raw, shard, bits, shard_bits))
                while len(held) > 1 and 2 * len(held[-1][0]) >= len(held[-2][0]):
                    held[-2:] = [summed(held[-2:], bits)]
        if held:
            yield rows()

    return found.repartition("shard").sortWithinPartitions("shard").mapInArrow(work, "ids array<long>, a long")


# --- candidates ---


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, most_words: int) -> DataFrame:
    """lang, words, a and ``ones`` (each word's own count) of all phrases with ``least`` occurrences."""
    spark = docs.sparkSession
    n, top, occurrences = words.agg(F.count("*"), F.max("id"), F.sum("n")).first()
    bits = 2 * max(1, (top or 1).bit_length())
    if bits > 64:
        raise ValueError("more than 2**32 frequent words")
    shard_bits = min(max(0, (3 * (occurrences or 0) // SHARD).bit_length()), MOST_SHARD_BITS, bits)
    ids = None
    if n <= most_words:
        by_lang: dict[str, dict[bytes, int]] = {}
        for r in words.select("id", "lang", "word").limit(most_words).collect():
            by_lang.setdefault(r.lang, {})[r.word.encode()] = r.id
        ids = spark.sparkContext.broadcast(by_lang)
    else:
        docs = with_own_ids(docs, words)
    found = written(merged(filters(docs, ids, bits, shard_bits), least, bits, shard_bits).withColumn("_g", F.monotonically_increasing_id()), "phrases")
    each = found.select("_g", "a", F.posexplode(F.filter("ids", lambda x: x != 0)).alias("_p", "_id"))
    named = join_small(each, words, each["_id"] == words["id"])
    parts = named.groupBy("_g", "a").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("_p", "word", "n"))).alias("x"))
    return written(parts.select("_g", "lang", "a", F.col("x.word").alias("words"), F.col("x.n").alias("ones")), "candidates")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(candidates: DataFrame) -> DataFrame:
    """Adds phrase, l, r and score: of the cut with the lowest score."""
    size = F.size("words")
    cuts = F.sequence(F.lit(1), size - 1)
    own = candidates.withColumn("phrase", joined(F.col("words")))
    asked = own.filter(size > 2).select("_g", "lang", F.explode(cuts).alias("k"), "words")
    sides = F.array(F.struct((2 * F.col("k")).alias("side"), F.slice("words", 1, F.col("k")).alias("w")), F.struct((2 * F.col("k") + 1).alias("side"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("w")))
    parts = asked.select("_g", "lang", F.explode(sides).alias("s")).filter(F.size("s.w") > 1).select("_g", "lang", "s.side", joined(F.col("s.w")).alias("_part"))
    known = own.select(F.col("lang").alias("_l"), F.col("phrase").alias("_phrase"), F.col("a").alias("_a"))
    told = parts.join(known.hint("merge"), (parts["lang"] == known["_l"]) & (parts["_part"] == known["_phrase"]))
    counts = told.groupBy(F.col("_g").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("side", "_a"))).alias("_told"))  # at most four of a candidate
    both = own.join(counts.hint("merge"), F.col("_g") == F.col("_of"), "left")

    def at(k: Column) -> Column:
        left = F.when(k == 1, F.element_at("ones", 1)).otherwise(F.element_at("_told", 2 * k))
        right = F.when(k == size - 1, F.element_at("ones", -1)).otherwise(F.element_at("_told", 2 * k + 1))
        return F.struct(k.alias("k"), left.alias("l"), right.alias("r"))

    marked = both.withColumn("_cuts", F.transform(cuts, at))
    # "div" of decimals is whole and exact
    lowest = F.expr(f"array_min(transform(_cuts, c -> struct((cast(a AS decimal(38,0)) * {SCALE}) div (cast(c.l AS decimal(38,0)) + c.r) AS score, c.k AS k, c.l AS l, c.r AS r)))")
    return marked.withColumn("_low", lowest).select(*own.columns, "_low.l", "_low.r", "_low.score")


def not_covered(found: DataFrame) -> DataFrame:
    """Candidates without those that mostly occur inside a longer one."""
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))")
    longer = found.filter(F.size("words") > 2).select(F.col("lang").alias("_l"), F.explode(F.array_distinct(inner)).alias("_inner"), "a").groupBy("_l", "_inner").agg(F.max("a").alias("_over"))
    both = found.join(longer.hint("merge"), (found["lang"] == longer["_l"]) & (found["phrase"] == longer["_inner"]), "left")
    return both.filter(F.col("_over").isNull() | (exact(F.col("_over")) * 100 < exact(F.col("a")) * COVERED)).select(*found.columns)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases, of ``docs`` (lang, text)."""
    has_columns(docs, "lang", "text")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = written(word_counts(texts), "words")
    per = counts.groupBy(F.col("lang").alias("_of")).agg(F.sum("n").alias("n"))
    found = not_covered(scored(phrase_counts(texts, dictionary(counts, least), least, most_words)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_turn", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_turn") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return join_small(best.select("lang", "rank", "phrase", "a", "l", "r", "score"), per, F.col("lang") == F.col("_of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (
  SELECT id, lang, unnest(x) AS w0, unnest(range(0, len(x))) AS pos FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM p)
), g AS (
  SELECT lang, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)
), f AS (
  SELECT lang, [w0] AS x, count(*) AS a FROM g GROUP BY lang, w0
  UNION ALL SELECT lang, [w0, w1], count(*) FROM g WHERE w1 IS NOT NULL GROUP BY lang, w0, w1
  UNION ALL SELECT lang, [w0, w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w0, w1, w2
  UNION ALL SELECT lang, [w0, w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w0, w1, w2, w3
), often AS (SELECT * FROM f WHERE a >= 30),
c AS (SELECT * FROM often WHERE len(x) > 1),
cut AS (SELECT lang, x, a, unnest(range(1, len(x))) AS k FROM c),
s AS (
  SELECT cut.lang, cut.x, cut.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM cut JOIN often l ON l.lang = cut.lang AND l.x = cut.x[: k] JOIN often r ON r.lang = cut.lang AND r.x = cut.x[k + 1 :]
), low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, x[i : i + k - 1] AS x, max(a) AS over_a
  FROM (SELECT lang, x, a, k, unnest(range(1, len(x) - k + 2)) AS i FROM (SELECT lang, x, a, unnest(range(2, len(x))) AS k FROM c WHERE len(x) > 2)) GROUP BY ALL
), kept AS (
  SELECT low.* FROM low LEFT JOIN inner_part i ON i.lang = low.lang AND i.x = low.x WHERE over_a IS NULL OR 100::HUGEINT * over_a < 80::HUGEINT * a
), ranked AS (
  SELECT lang, array_to_string(x, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(x, ' '))) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(x) = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {"op11_collocations": ORACLE}

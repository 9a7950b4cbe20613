"""Importance resampling: documents weighed by target against raw text, sampled by Gumbel top-k.

Words and word pairs, lower-cased in A-Z, are hashed into ``BUCKETS`` buckets.  Two multinomial models with added
counts, of the target texts (documents labelled as good) and of all documents, give each document a weight, the
ratio of its probabilities under the two, as if it had ``LENGTH`` n-grams: the mean log ratio of its n-grams times LENGTH.  So a
long text does not outweigh a short one, and weights are of the noise's order.  Adding seeded Gumbel noise to the logarithm
of the weight and taking the k highest draws k documents without replacement in proportion to their weights.

Counts are vectors of BUCKETS numbers: each task sums its own and they are added up, so what reaches the driver
and is sent to the tasks has that size whatever the input.  The target model is fitted on at most ``sample`` labelled
rows, those with the smallest hash of doc_id; the raw model, the weights and the k-th key cover all documents.
The k-th key is found by narrowing histograms, not by sorting.

Defined cases: null, empty or blank texts have no words and weight 1; ties at the k-th key are all kept, so repeated
rows stay or go together; labels that are null, or for no document, count for nothing; without any target text all
weights are 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, cut, has_columns, mixed, slices, table, texts_of

BUCKETS = 1 << 16
#: Labelled rows that the target model is fitted on at most.
SAMPLE = 50_000
#: Documents to draw, out of 1000.
DRAWN = 850
SEED = 11
#: The number of n-grams that every text counts as.
LENGTH = 16
#: Bins of a histogram of keys, and the number of keys that are sorted at once.
BINS = 4096
SORTED = 10_000


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, text after text, and each text's number of them."""
    codes = WordCodes()
    each = [codes.of((t or b"").lower().split()) for t in texts]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes))
    out, sizes = [], []
    for ids in each:
        h = hashes[ids] if len(ids) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            pair = mixed(h[:-1] * np.uint64(3) + h[1:])
        out += [h, pair]
        sizes.append(len(h) + len(pair))
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64) if out else np.zeros(0, np.int64), np.array(sizes, np.int64)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts: one vector of BUCKETS numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(grams(texts_of(batch, "text"))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    t, r = target + 1.0, raw + 1.0
    return np.log(t / t.sum()) - np.log(r / r.sum())


def kth_highest(keys: DataFrame, k: int) -> float | None:
    """The k-th highest value of the column ``key``, by histograms of the interval that holds it."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or not n:
        return None
    k = min(k, n)
    while n > SORTED and low < high:
        width = (high - low) / BINS
        if low + width == low:
            break
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()  # at most BINS rows
        for row in sorted(bins, key=lambda r: -r["b"]):
            if k <= row["n"]:
                low, high, n = row["a"], row["z"], row["n"]
                break
            k -= row["n"]
    if low == high:
        return low
    inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
    # SORTED rows at most, or else the few doubles that lie between ends so near
    for row in sorted(inside.groupBy("key").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["key"]):
        if k <= row["n"]:
            return row["key"]
        k -= row["n"]
    return low


def weighed(docs: DataFrame, ratio: np.ndarray, seed: int = SEED, length: float = LENGTH) -> DataFrame:
    """doc_id, n_grams, log_weight and key of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, sizes = grams(texts_of(batch, "text"))
            ends = np.cumsum(sizes)
            # each text summed on its own, so that its weight does not depend on its neighbours
            weight = np.array([np.sum(ratio[buckets[a:b]]) * length / max(b - a, 1) for a, b in zip(ends - sizes, ends, strict=True)], np.float64)
            ids = [0 if i is None else i for i in batch.column("doc_id").to_pylist()]
            draw = (mixed(np.array(ids, np.int64).view(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
            gumbel = -np.log(-np.log((draw + 0.5) / 2.0**53))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(weight), pa.array(weight + gumbel)], names=["doc_id", "n_grams", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_grams long, log_weight double, key double")


def resample(docs: DataFrame, labels: DataFrame, drawn: int = DRAWN, sample: int = SAMPLE, seed: int = SEED, length: float = LENGTH) -> DataFrame:
    """doc_id, n_grams, log_weight, key and kept for every row of ``docs``; ``labels`` has doc_id and quality."""
    has_columns(docs, "doc_id", "text")
    has_columns(labels, "doc_id", "quality")
    good = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    target = gram_counts(docs.join(F.broadcast(good), "doc_id", "left_semi"))  # at most ``sample`` ids
    keys = cut(weighed(docs, log_ratio(target, gram_counts(docs)), seed, length))
    edge = kth_highest(keys, -(-keys.count() * drawn // 1000))
    return keys.select("*", (F.col("key") >= F.lit(edge)).alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE_SQL: dict[str, str] = {}

"""Quality rules with thresholds that follow each language and source.

Every document gets a few counts.  A quantile sketch per (lang, source) and measure, logarithmic buckets
whose counts merge by addition, gives quartiles; a document is rejected where a measure lies beyond the
quartiles by several quartile distances.  Groups of fewer than ``least`` documents use the merged sketch of
their language, and small languages the merged sketch of all.

Defined cases: null or wordless text has no words and fails the base rule; null ``lang``/``source`` form a
group of their own; repeated rows are judged row by row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, WordCodes, cut, has_columns, join_small, mixed, slices, table, texts_of, windows

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Each measure: numerator, denominator, and the least distance of its fences from the quartiles.
MEASURES = {
    "word_length": ("word_chars", "n_words", 1.5),
    "symbol_rate": ("n_symbols", "n_words", 0.1),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.35),
    "repeat_rate": ("n_repeat_words", "n_words", 0.25),
}
GAMMA = 1.02
FLOOR = 0.001


def counts(text: bytes | None, codes: WordCodes, noise: list[np.ndarray]) -> tuple[int, ...]:
    """The base counts of one text; ``noise[0]`` holds a random 64-bit number for each word code."""
    if not text:
        return (0,) * 6
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, BLANKS)) if text.isascii() else len(text.translate(None, BLANKS).decode())
    repeat = 0
    if n > 8:
        ids = codes.of(words)
        if len(codes) > len(noise[0]):
            noise[0] = mixed(np.arange(2 * len(codes)))
        keys = windows(noise[0][ids], 8)
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(keys, twice))
            edge = np.zeros(n + 1, np.int64)
            edge[at] += 1
            edge[at + 8] -= 1
            repeat = int(np.count_nonzero(np.cumsum(edge[:n]) > 0))
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines)


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the counts of the whole texts, named with a leading underscore.

    A text that is kept is sent to the workers once.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"_{c}", T.LongType(), False) for c in COUNTS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            codes, noise = WordCodes(), [np.zeros(0, np.uint64)]
            rows = np.array([counts(t, codes, noise) for t in texts_of(batch, text)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(rows[:, i]) for i in range(len(COUNTS))],
                names=[*keep, *(f"_{c}" for c in COUNTS)],
            )

    return docs.select(*keep, *[text] * (text not in keep)).mapInArrow(work, schema)


def base_failed() -> Column:
    return (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))


def measure(name: str) -> Column:
    top, below, _ = MEASURES[name]
    return F.col(f"_{top}").cast("double") / F.greatest(F.col(f"_{below}"), F.lit(1)).cast("double")


def bucket(value: Column) -> Column:
    """Buckets of 2 % width: the upper ends are FLOOR * GAMMA ** bucket; 0 holds all that is at most FLOOR."""
    return F.when(value <= FLOOR, F.lit(0)).otherwise(F.ceil(F.log(value / F.lit(FLOOR)) / F.log(F.lit(GAMMA)))).cast("int")


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the sketches of documents that pass the base rule; they merge by summing n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(measure(m)).alias("bucket")) for m in MEASURES]))
    return (
        counted.filter(~base_failed())
        .select("_lang", "_source", each.alias("x"))
        .groupBy("_lang", "_source", F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, least: int = 200, spread: float = 6.0) -> DataFrame:
    """One row per (lang, source): the lowest and highest accepted value of each measure."""
    levels = []
    for level, keys in enumerate((["_lang", "_source"], ["_lang"], [])):
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        # every bucket of a measure: about a thousand values, so the window below stays small whatever the input
        packed = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))

        def quartile(q: int) -> Column:
            need = F.col("total") * q
            found = F.aggregate(
                "h",
                F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at")),
                lambda a, x: F.when(a["at"] >= 0, a).otherwise(
                    F.struct((a["seen"] + x["n"]).alias("seen"), F.when(4 * (a["seen"] + x["n"]) >= need, x["bucket"]).otherwise(F.lit(-1)).alias("at"))
                ),
            )["at"]
            return F.when(found == 0, F.lit(0.0)).otherwise(F.lit(FLOOR) * F.pow(F.lit(GAMMA), found))

        levels.append(
            packed.select(*keys, "measure", F.col("total").alias(f"total{level}"), quartile(1).alias(f"q1_{level}"), quartile(3).alias(f"q3_{level}"))
        )
    own, lang, every = levels
    # these tables have one row for each group and measure
    found = own.join(lang.hint("merge"), own["measure"].eqNullSafe(lang["measure"]) & own["_lang"].eqNullSafe(lang["_lang"])).select(own["*"], "total1", "q1_1", "q3_1")
    found = found.join(every.hint("broadcast"), "measure")  # as many rows as there are measures
    pick = lambda c: F.when(F.col("total0") >= least, F.col(f"{c}_0")).when(F.col("total1") >= least, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    found = found.select("_lang", "_source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    slack = F.coalesce(*[F.when(F.col("measure") == m, F.lit(x[2])) for m, x in MEASURES.items()])
    reach = F.greatest(spread * (F.col("q3") - F.col("q1")), slack)
    return found.groupBy("_lang", "_source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"low_{m}") for m in MEASURES],
        *[F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"high_{m}") for m in MEASURES],
    )


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``_base_failed`` and ``_kept``."""
    limits = limits.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = join_small(counted, limits, counted["_lang"].eqNullSafe(limits["_l"]) & counted["_source"].eqNullSafe(limits["_s"]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (measure(m) <= F.col(f"high_{m}")) & (measure(m) >= F.col(f"low_{m}"))
    return joined.select(*[counted[c] for c in counted.columns], base_failed().alias("_base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("_kept"))


def quality_rules(docs: DataFrame, least: int = 200, spread: float = 6.0) -> DataFrame:
    """doc_id, counts, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source)."""
    has_columns(docs, "doc_id", "text", "lang", "source")
    named = docs.select("doc_id", "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    counted = cut(with_counts(named, ["doc_id", "_lang", "_source"]))
    out = judged(counted, cut(fences(sketches(counted), least, spread)))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS[:5]], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def kept_documents(docs: DataFrame, least: int = 200, spread: float = 6.0) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    The counts are made twice, once for the sketches and once beside the whole rows, which spares a shuffle
    of the texts.
    """
    has_columns(docs, "text", "lang", "source")
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index("text")]
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, own, strict=True)], F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    limits = cut(fences(sketches(with_counts(renamed.select(text, "_lang", "_source"), ["_lang", "_source"], text)), least, spread))
    kept = judged(with_counts(renamed, [*own, "_lang", "_source"], text), limits).filter("_kept")
    return kept.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, own, strict=True)])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), grams AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 9
), g AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS gram FROM grams
), twice AS (
  SELECT r, gram FROM g GROUP BY r, gram HAVING count(*) > 1
), spots AS (
  SELECT DISTINCT g.r, g.i + k.k AS p FROM g JOIN twice USING (r, gram), (SELECT unnest(range(0, 8)) AS k) k
), rep AS (
  SELECT r, count(*) AS n_repeat_words FROM spots GROUP BY r
), lines AS (
  SELECT r, x FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines GROUP BY r
), c AS (
  SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN dup ON w.r = dup.r
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars / greatest(n_words, 1)::DOUBLE AS m1, n_symbols / greatest(n_words, 1)::DOUBLE AS m2,
         n_dup_lines / greatest(n_lines, 1)::DOUBLE AS m3, n_repeat_words / greatest(n_words, 1)::DOUBLE AS m4
  FROM c
), v AS (
  SELECT lang, source, 1 AS m, m1 AS x FROM b WHERE NOT base_failed UNION ALL
  SELECT lang, source, 2, m2 FROM b WHERE NOT base_failed UNION ALL
  SELECT lang, source, 3, m3 FROM b WHERE NOT base_failed UNION ALL
  SELECT lang, source, 4, m4 FROM b WHERE NOT base_failed
), s AS (
  SELECT lang, source, m, CASE WHEN x <= 0.001 THEN 0 ELSE ceil(ln(x / 0.001) / ln(1.02::DOUBLE)) END AS k, count(*) AS n FROM v GROUP BY ALL
), s0 AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY k) AS c, sum(n) OVER (PARTITION BY lang, source, m) AS t FROM s),
s1 AS (SELECT *, sum(n) OVER (PARTITION BY lang, m ORDER BY k) AS c, sum(n) OVER (PARTITION BY lang, m) AS t FROM (SELECT lang, m, k, sum(n) AS n FROM s GROUP BY ALL)),
s2 AS (SELECT *, sum(n) OVER (PARTITION BY m ORDER BY k) AS c, sum(n) OVER (PARTITION BY m) AS t FROM (SELECT m, k, sum(n) AS n FROM s GROUP BY ALL)),
q0 AS (SELECT lang, source, m, max(t) AS t, min(k) FILTER (4 * c >= t) AS a, min(k) FILTER (4 * c >= 3 * t) AS z FROM s0 GROUP BY ALL),
q1 AS (SELECT lang, m, max(t) AS t, min(k) FILTER (4 * c >= t) AS a, min(k) FILTER (4 * c >= 3 * t) AS z FROM s1 GROUP BY ALL),
q2 AS (SELECT m, min(k) FILTER (4 * c >= t) AS a, min(k) FILTER (4 * c >= 3 * t) AS z FROM s2 GROUP BY ALL),
q AS (
  SELECT q0.lang, q0.source, q0.m,
         CASE WHEN q0.t >= 200 THEN q0.a WHEN q1.t >= 200 THEN q1.a ELSE q2.a END AS a,
         CASE WHEN q0.t >= 200 THEN q0.z WHEN q1.t >= 200 THEN q1.z ELSE q2.z END AS z
  FROM q0 JOIN q1 ON q0.m = q1.m AND q0.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON q0.m = q2.m
), qv AS (
  SELECT lang, source, m, CASE WHEN a = 0 THEN 0 ELSE 0.001::DOUBLE * pow(1.02::DOUBLE, a) END AS a, CASE WHEN z = 0 THEN 0 ELSE 0.001::DOUBLE * pow(1.02::DOUBLE, z) END AS z FROM q
), f AS (
  SELECT lang, source, m, a - greatest(6 * (z - a), [1.5, 0.1, 0.35, 0.25][m]::DOUBLE) AS lo, z + greatest(6 * (z - a), [1.5, 0.1, 0.35, 0.25][m]::DOUBLE) AS hi FROM qv
), bad AS (
  SELECT DISTINCT b.r FROM b JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
  WHERE [b.m1, b.m2, b.m3, b.m4][f.m] < lo OR [b.m1, b.m2, b.m3, b.m4][f.m] > hi
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.r NOT IN (SELECT r FROM bad) AS kept FROM b
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL = {"op5_quality_rules": ORACLE}

"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets.  Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` times all
words; a target stops at ``most`` times its source's size and the excess is shared again by weight.  With the
sources sorted by size over weight, those that stop are a prefix, so one pass of running sums finds the level.

Blocks.  Each source is dealt into shards by a seeded hash of doc_id, about ``shard_words`` words each, so the
largest source has the most shards and a task holds a shard, and what repeats one of its ids.  Inside a shard the documents stand
in seeded order and their words form blocks of ``block_words`` (the last may be shorter).  Every source gets as
many blocks as highest-quotient apportionment (divisors 1, 3, 5, ...) of its target gives it, and the same rule
divides them among its shards.  A shard with a quota of q blocks and n blocks is taken q div n times whole; the
other q mod n blocks run on from a seeded block, around the shard's end.  What a document gives is then the
overlap of its words with that run: no block is ever made a row.

Defined cases: a null or wordless text has size 0 and gives nothing; a long text is one document of its shard; rows that repeat
a doc_id stand side by side in one shard; a row without doc_id is dealt by a digest of its text instead, so that many of
them spread over the shards, and those of one text stand side by side; a source without words has target 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, has_columns, join_small, table

WEIGHTS = (5, 2, 1)
SEED = "mix"


def words(text: Column) -> Column:
    """The number of words: word starts are what follows a blank or the beginning."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: Column | str) -> Column:
    """32 seeded bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = 150, most: int = 2) -> DataFrame:
    """_source, source_size, target: one row per source.  ``share`` is in hundredths.

    The windows run over one row per source, not over documents.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    ranked = per.select("*", rank.alias("place"), weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") * 1.0 / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    running = ranked.select(
        "*",
        F.row_number().over(by_level).alias("step"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(whole).alias("all"),
        F.sum("weight").over(whole).alias("all_weight"),
    )
    # hundredths of words that are left for a unit of weight if the sources before this one stop
    left = share * F.col("all").cast("double") - 100.0 * F.col("capped")
    fits = left <= 100.0 * F.col("cap") * (F.col("all_weight") - F.col("gone")) / F.col("weight")
    at = running.select("*", left.alias("left"), F.when(fits, F.col("step")).alias("fit"))
    level = at.select("*", F.min("fit").over(whole).alias("first"))
    level = level.select(
        "*",
        F.max(F.when(F.col("step") == F.col("first"), F.col("left"))).over(whole).alias("rest"),
        F.max(F.when(F.col("step") == F.col("first"), F.col("all_weight") - F.col("gone"))).over(whole).alias("units"),
    )
    target = F.when(F.col("step") < F.col("first"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest") / (100.0 * F.col("units")))
    return level.select("_source", "source_size", F.coalesce(F.when(F.col("all") > 0, F.coalesce(target, F.col("cap").cast("double"))), F.lit(0.0)).alias("target"))


def apportion(votes: DataFrame, within: list[str], vote: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: ``seats`` (the same in a group) dealt to the rows of each ``within`` by highest quotients vote / (2k + 1).

    Rounding vote * seats / total gives what quotients above the mean price win; the few seats over or
    missing go by the quotients next in line, of which each row offers as many as its group lacks.
    """
    w = Window.partitionBy(*within)
    price = F.sum(vote).over(w).cast("double") / F.greatest(F.col(seats), F.lit(1))
    start = F.when(F.col(vote) > 0, F.floor(F.col(vote) / F.col("_price") + 0.5)).otherwise(F.lit(0)).cast("long")
    first = votes.select("*", price.alias("_price")).select("*", F.when(F.col("_price") > 0, start).otherwise(F.lit(0)).cast("long").alias("_won"))
    rank = F.row_number().over(w.orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    first = first.select("*", (F.col(seats) - F.sum("_won").over(w)).alias("_lack"), rank.alias("_rank"))
    # missing seats: the next quotients, highest first; seats too many: the last won, lowest first
    count = F.least(F.abs("_lack"), F.when(F.col("_lack") < 0, F.col("_won")).otherwise(F.when(F.col(vote) > 0, F.abs("_lack")).otherwise(F.lit(0))))
    offers = first.filter("_lack <> 0").withColumn("_offer", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))))
    k = F.when(F.col("_lack") > 0, F.col("_won") + F.col("_offer")).otherwise(F.col("_won") - 1 - F.col("_offer"))
    quotient = F.col(vote) / (2.0 * k + 1)
    turn = F.row_number().over(Window.partitionBy(*within).orderBy(F.when(F.col("_lack") > 0, -quotient).otherwise(quotient), F.signum("_lack") * F.col("_rank"), "_offer"))
    moved = offers.select("*", turn.alias("_turn")).filter(F.col("_turn") <= F.abs("_lack")).groupBy(*dict.fromkeys([*within, *order])).agg(F.sum(F.signum("_lack").cast("long")).alias("_moved"))
    keys = list(dict.fromkeys([*within, *order]))
    moved = moved.withColumnsRenamed({c: f"_m_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on = on & first[c].eqNullSafe(moved[f"_m_{c}"])
    return first.join(moved.hint("merge"), on, "left").select(*[first[c] for c in votes.columns], (F.col("_won") + F.coalesce("_moved", F.lit(0))).alias(out))


def plan(docs: DataFrame, block_words: int = 64, shard_words: int = 1 << 20, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: int = 150, most: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and where the taken run lies (``_whole``, ``_p``, ``_from``, ``_to``, ``_len``)."""
    has_columns(docs, "doc_id", "text", "source")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt_by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    sized = cut(docs.select("doc_id", *keep, F.col("source").alias("_source"), words(F.col("text")).alias("size"), draw(F.lit(seed), dealt_by).alias("_draw")))
    goal = cut(targets(sized, weights, share, most))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    goal = goal.select("*", shards.alias("_shards"), F.lit(0).alias("_all"))
    total = F.floor(F.sum("source_size").over(Window.partitionBy("_all")) * (share / 100.0) / block_words + 0.5)
    goal = cut(apportion(goal.withColumn("_seats", total.cast("long")), ["_all"], "target", "_seats", ["_source"], "_blocks"))
    g = goal.select(F.col("_source").alias("_s"), "source_size", "target", "_shards", "_blocks")
    dealt = join_small(sized, g, sized["_source"].eqNullSafe(g["_s"])).withColumn("_shard", F.col("_draw") % F.col("_shards"))
    # a shard holds about shard_words words, whatever its source
    in_shard = Window.partitionBy("_source", "_shard").orderBy("_draw", key, "size")
    placed = dealt.select("*", (F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_p"))
    per = dealt.groupBy("_source", "_shard").agg(F.sum("size").alias("_len"), F.max("_blocks").alias("_seats"))
    quota = apportion(per, ["_source"], "_len", "_seats", ["_shard"], "_quota")
    n = F.ceil(F.col("_len") / block_words)
    quota = quota.select("_source", "_shard", "_len", n.alias("_n"), F.least(F.col("_quota"), most * n).alias("_q"), draw(F.lit(seed), F.col("_shard").cast("string"), F.coalesce("_source", F.lit(""))).alias("_start"))
    quota = quota.select(
        F.col("_source").alias("_s2"),
        F.col("_shard").alias("_h2"),
        "_len",
        F.when(F.col("_n") > 0, F.floor(F.col("_q") / F.col("_n"))).otherwise(F.lit(0)).alias("_whole"),
        F.when(F.col("_n") > 0, (F.col("_start") % F.col("_n")) * block_words).otherwise(F.lit(0)).alias("_from"),
        F.when(F.col("_n") > 0, (F.col("_start") % F.col("_n") + F.col("_q") % F.col("_n")) * block_words).otherwise(F.lit(0)).alias("_to"),
        (F.col("_n") * block_words).alias("_ring"),
    )
    quota = cut(quota)
    out = join_small(placed, quota, placed["_source"].eqNullSafe(quota["_s2"]) & (placed["_shard"] == quota["_h2"]))
    end = F.col("_p") + F.col("size")
    overlap = lambda a, b: F.greatest(F.least(end, b) - F.greatest(F.col("_p"), a), F.lit(0))
    run = overlap(F.col("_from"), F.col("_to")) + overlap(F.lit(0), F.col("_to") - F.col("_ring"))
    return out.select("doc_id", *keep, "size", "source_size", "target", (F.col("_whole") * F.col("size") + run).cast("long").alias("taken"), "_whole", "_p", "_from", "_to", "_ring")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, text, source)."""
    return plan(docs, **how).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, to the nearest whole number, with its columns as they are.

    Rows that repeat a doc_id with another text are taken apart.  Rows that repeat both share what they are taken together: each
    the whole part, and each by a seeded draw one more, with the odds that the rest asks for.
    A document's fraction is rounded by where the run of blocks meets its middle word, so sources keep to
    their targets within a document at either end of a shard's run.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, own, strict=True)], "doc_id", "text", "source")
    middle = F.col("_p") + F.floor(F.col("size") / 2)
    inside = ((middle >= F.col("_from")) & (middle < F.col("_to"))) | (middle < F.col("_to") - F.col("_ring"))
    times = F.when(F.col("size") > 0, F.col("_whole") + inside.cast("long")).otherwise(F.lit(0))
    # only identifiers and marks of the texts travel through the plan; the texts are joined to their counts once
    mark = F.xxhash64("text").alias("_mark")
    asked = renamed.select("doc_id", "text", "source", mark, F.col("source").alias("_from_source"))
    counted = plan(asked, keep=("_mark", "_from_source"), **how).groupBy("doc_id", "_mark", "_from_source").agg(F.sum(times).alias("_times"), F.count("*").alias("_rows")).filter("_times > 0")
    counted = cut(counted).withColumnsRenamed({"doc_id": "_id", "_mark": "_m", "_from_source": "_s"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m")) & F.col("source").eqNullSafe(F.col("_s"))
    turn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "_mark"), F.lit(1 << 40)).alias("_turn")
    joined = renamed.select("*", mark, turn).join(counted.hint("merge"), same)
    more = (F.col("_turn") % F.col("_rows") < F.col("_times") % F.col("_rows")).cast("long")
    own_times = F.floor(F.col("_times") / F.col("_rows")) + more
    copies = joined.withColumn("_own", own_times).filter("_own > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own"))))
    return copies.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, own, strict=True)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, '')))), 1, 8))::BIGINT AS h
  FROM documents
), p AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM p),
w AS (SELECT *, [5, 2, 1][place % 3 + 1]::BIGINT AS w, 2 * z AS cap FROM k),
r AS (
  SELECT *, row_number() OVER o AS step, (sum(z) OVER ())::BIGINT AS al, (sum(w) OVER ())::BIGINT AS aw,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
  FROM w WINDOW o AS (ORDER BY cap / w::DOUBLE, place)
), f AS (SELECT *, 150 * al::DOUBLE - 100 * c::DOUBLE AS rest, CASE WHEN 150 * al::DOUBLE - 100 * c::DOUBLE <= 100::DOUBLE * cap * (aw - g) / w THEN step END AS fit FROM r),
l AS (SELECT *, min(fit) OVER () AS first FROM f),
m AS (SELECT *, max(CASE WHEN step = first THEN rest END) OVER () AS lr, max(CASE WHEN step = first THEN aw - g END) OVER () AS lu FROM l),
t AS (
  SELECT source, z, CASE WHEN al = 0 THEN 0 WHEN step < first THEN cap::DOUBLE ELSE w * lr / (100.0::DOUBLE * lu) END AS target,
         greatest(ceil(z / 1048576.0::DOUBLE), 1)::BIGINT AS shards
  FROM m
), n AS (SELECT floor(sum(z)::DOUBLE * 1.5::DOUBLE / 64 + 0.5::DOUBLE)::BIGINT AS seats FROM t),
q AS (
  SELECT source, target / (2 * i + 1) AS quotient, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, source) AS turn
  FROM t, n, unnest(range(0, (target / 64)::BIGINT + (SELECT count(*) FROM t)::BIGINT)) AS u(i) WHERE target > 0
), b AS (SELECT source, count(*) AS blocks FROM q, n WHERE turn <= seats GROUP BY source),
dealt AS (
  SELECT d.*, t.z, t.target, coalesce(b.blocks, 0) AS blocks, h % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
), placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY h, coalesce(doc_id::VARCHAR, ''), size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS p FROM dealt
), sh AS (SELECT source, shard, sum(size)::BIGINT AS len, max(blocks) AS seats, max(z) AS z FROM dealt GROUP BY source, shard),
sq AS (
  SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY len / (2.0::DOUBLE * i + 1) DESC, shard) AS turn
  FROM sh, unnest(range(0, (len * seats / greatest(z, 1))::BIGINT + 64)) AS u(i) WHERE len > 0
), quota AS (SELECT source, shard, count(*) AS q FROM sq WHERE turn <= seats GROUP BY source, shard),
e AS (
  SELECT sh.source, sh.shard, ceil(len / 64.0::DOUBLE)::BIGINT AS n, least(coalesce(q, 0), 2 * ceil(len / 64.0::DOUBLE)::BIGINT) AS q,
         ('0x' || substr(md5('mix|' || sh.shard || '|' || coalesce(sh.source, '')), 1, 8))::BIGINT AS s
  FROM sh LEFT JOIN quota ON sh.source IS NOT DISTINCT FROM quota.source AND sh.shard = quota.shard
), x AS (SELECT source, shard, CASE WHEN n > 0 THEN q // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN (s % n) * 64 ELSE 0 END AS a, CASE WHEN n > 0 THEN (s % n + q % n) * 64 ELSE 0 END AS z, n * 64 AS ring FROM e)
SELECT doc_id, size, placed.z AS source_size, target,
       (whole * size + greatest(least(p + size, x.z) - greatest(p, a), 0) + greatest(least(p + size, x.z - ring) - p, 0))::BIGINT AS taken
FROM placed JOIN x ON placed.source IS NOT DISTINCT FROM x.source AND placed.shard = x.shard
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {"op7_mixing": ORACLE}

"""Nearest benchmark vectors: exact top-n in blocks, thresholds, best of two queries, and an exact join of near vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20_000
QUERIES = 1_000
#: Vectors of a chunk of the join of near vectors.
CHUNK = 500


def nearest(queries: DataFrame, corpus: DataFrame, n: int, metric: str = "l2sq", least: float | None = None) -> DataFrame:
    """query_id, rank, id and similarity of the ``n`` most similar of ``corpus`` (id, vec) for each of ``queries`` (query_id, vec).

    Similarity is 1 - distance, to three places: of the squared Euclidean distance, or of the cosine distance.  The corpus is
    dealt into blocks and the queries into chunks, each pair of which meets in one group as two matrices; a group returns
    the best of its block for each query, and a window the best of all.  Ties go to the smaller id; rows below ``least``
    are left out; vectors that are null, empty, of another length or hold nulls take no part.
    """
    fine = lambda v: F.size(v).cast("int") * F.when(F.exists(v, lambda x: x.isNull()), 0).otherwise(1)
    sized = lambda df, key: df.select(F.col(key).alias("id"), F.col("vec").cast("array<double>").alias("vec")).withColumn("d", F.coalesce(fine(F.col("vec")), F.lit(0))).filter("d > 0")
    asked, held = sized(queries, "query_id"), sized(corpus, "id")
    blocks, chunks = max(1, -(-held.count() // BLOCK)), max(1, -(-asked.count() // QUERIES))
    place = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = held.select("d", place(blocks).alias("block"), every(chunks).alias("chunk"), F.lit(False).alias("ask"), "id", "vec")
    b = asked.select("d", every(blocks).alias("block"), place(chunks).alias("chunk"), F.lit(True).alias("ask"), "id", "vec")

    def group(data: pa.Table) -> pa.Table:
        ask = np.asarray(data.column("ask"))
        out: list[tuple[np.ndarray, ...]] = []
        sides = [data.filter(pa.array(k)).combine_chunks() for k in (ask, ~ask)]
        if all(s.num_rows for s in sides):
            (qi, q), (ci, c) = ((np.asarray(s.column("id")), s.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1)) for s in sides)
            order = np.argsort(ci, kind="stable")
            ci, c = ci[order], c[order]
            for i in range(0, len(q), 64):
                part = q[i : i + 64]
                with np.errstate(divide="ignore", invalid="ignore"):
                    if metric == "l2sq":
                        near = np.stack([1 - ((c - x) ** 2).sum(axis=1) for x in part])
                    else:
                        near = (part @ c.T) / (np.sqrt((part**2).sum(axis=1))[:, None] * np.sqrt((c**2).sum(axis=1)))
                for j, x in enumerate(near):
                    places = np.floor(x * 1000 + 0.5)
                    close = np.abs(x * 1000 + 0.5 - np.rint(x * 1000 + 0.5)) < 1e-6  # rounding might decide; all of these go on
                    first = np.argsort(-places, kind="stable")[:n]
                    at = np.union1d(first, np.flatnonzero(close & (places >= places[first[-1]] - 1)))
                    at = at[~np.isnan(x[at])]
                    out.append((np.full(len(at), qi[i + j]), ci[at], x[at]))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(v) for v in columns], names=["query_id", "id", "similarity"])

    scored = a.union(b).groupBy("d", "block", "chunk").applyInArrow(group, "query_id long, id long, similarity double").withColumn("similarity", F.round("similarity", 3))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    top = scored.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)
    return top if least is None else top.filter(F.col("similarity") >= least)


def best_of(found: list[DataFrame], least: float) -> DataFrame:
    """The best row of each query over several searches, the earlier search at ties."""
    both = found[0].withColumn("search", F.lit(0))
    for i, f in enumerate(found[1:], 1):
        both = both.unionByName(f.withColumn("search", F.lit(i)))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "search", "rank")
    return both.filter(F.col("similarity") >= least).select("*", F.row_number().over(w).alias("_turn")).filter("_turn = 1").drop("_turn")


def text_vectors(docs: DataFrame, id_column: str, features: int = 1 << 12) -> DataFrame:
    """id and the normalised TF-IDF vector of each text: the default embedder."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = docs.select(F.col(id_column).alias("id"), F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+").alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=features).transform(words)
    weighted = IDF(inputCol="tf", outputCol="idf").fit(counted).transform(counted)
    return Normalizer(inputCol="idf", outputCol="features").transform(weighted).select("id", "features")


#: A model: the vectors of a list of texts, one row each.
Model = Callable[[list[str]], np.ndarray]


def embedded(texts: DataFrame, id_column: str, load: Callable[[], Model], at_once: int = 256) -> DataFrame:
    """id and vec, the vector of each text by a model that each worker loads once for its task.

    ``load`` is called on the worker and returns the model, which gets at most ``at_once`` texts at a time; a null text is empty.
    """
    kind = texts.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                vectors = np.asarray(model([t or "" for t in batch.column("text").to_pylist()]), np.float64)
                flat = pa.array(np.ascontiguousarray(vectors).ravel())
                offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, flat)], names=["id", "vec"])

    return texts.select(F.col(id_column).alias("id"), "text").mapInArrow(work, f"id {kind}, vec array<double>")


def letter_counts() -> Model:
    """A model without parameters: how often each letter from a to z stands in a text."""

    def model(texts: list[str]) -> np.ndarray:
        rows = [np.bincount(np.frombuffer(t.encode().lower(), np.uint8), minlength=256)[97:123] for t in texts]
        return np.stack(rows).astype(np.float64) if rows else np.zeros((0, 26))

    return model


def nearest_texts(questions: DataFrame, texts: DataFrame, n: int, load: Callable[[], Model] = letter_counts, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """query_id, rank, id and similarity of the ``n`` texts (id, text) nearest to each question (query_id, text), by a model's vectors."""
    asked = embedded(questions, "query_id", load).withColumnRenamed("id", "query_id")
    return nearest(asked, embedded(texts, "id", load), n, metric, least)


def near_join(a: DataFrame, b: DataFrame, distance: float) -> DataFrame:
    """All pairs of vectors (columns id, vec) nearer than ``distance``: id, other, distance.

    Every chunk of ``a`` meets every chunk of ``b``, and only near pairs become rows.  Null vectors and those with
    missing or endless values are near to none; vectors of other lengths neither.
    """

    def chunks(df: DataFrame, name: str) -> DataFrame:
        fine = df.select("id", F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        # by row, for many rows may share an id
        dealt = fine.withColumn("_chunk", F.floor(F.monotonically_increasing_id() / CHUNK)).withColumn("_size", F.size("vec"))
        return dealt.groupBy("_chunk", "_size").agg(F.collect_list(F.struct("id", "vec")).alias(name)).select(name)

    left, right = chunks(a, "a"), chunks(b, "b")
    kind = a.schema["id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(rows: pa.StructArray) -> tuple[list, np.ndarray]:
            return rows.field("id").to_pylist(), rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                (ids, x), (others, y) = (vectors(batch.column(c)[i].values) for c in ("a", "b"))
                if x.shape[1] != y.shape[1]:
                    continue
                squares = (x * x).sum(1)[:, None] + (y * y).sum(1)
                p, q = np.nonzero(squares - 2 * x @ y.T <= distance * distance + 1e-9 * (1 + squares))
                exact = np.concatenate([np.sqrt(((x[p[k : k + 4096]] - y[q[k : k + 4096]]) ** 2).sum(1)) for k in range(0, len(p), 4096)] or [np.zeros(0)])
                near = np.flatnonzero(exact < distance)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in p[near]], arrow), pa.array([others[k] for k in q[near]], arrow), pa.array(exact[near])], names=["id", "other", "distance"])

    # lengths are compared by the worker: as a condition they would send all chunks to one task
    return left.crossJoin(right).mapInArrow(work, f"id {kind}, other {kind}, distance double")


#: What the weights of a document's words add up from: a word weighs this over its number of documents.
WEIGHT = 1_000_000
SALTS = 16


def found_texts(questions: DataFrame, docs: DataFrame, n: int, words: Callable[[Column], Column], small: int = 100_000) -> DataFrame:
    """query_id, rank, id and score of the ``n`` documents (id, text) that share the rarest words with each question (query_id, words).

    The questions' words meet the index of documents by word.  They are sent to it if they are few; else the two are shuffled by
    word.  A document meets a question once for each shared word, and these are summed where the document is read.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    few = asked.limit(small + 1).count() <= small
    hint = "broadcast" if few else "merge"
    postings = docs.select("id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    wanted = asked.select("word").distinct()
    held = postings.join(wanted.hint(hint), "word", "left_semi")
    weights = held.groupBy("word").agg(F.expr(f"{WEIGHT} div count(*)").alias("weight"))
    told = asked.join(weights.hint(hint), "word")
    scored = held.join(told.hint(hint), "word").groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    order = [F.desc("score"), F.asc("id")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = salted.withColumn("_turn", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).filter(F.col("_turn") <= n)
    return first.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank")).filter(F.col("rank") <= n)


def retrieval_quality(questions: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, recall, the mean recall of all questions and its verdict: the share of ``keywords`` that the found texts (query_id, id) hold together.

    Questions without keywords are left out; a question for which nothing was found has recall 0.
    """
    asked = questions.select("query_id", F.array_distinct("keywords").alias("keywords")).filter(F.size("keywords") > 0)
    pairs = found.select("query_id", "id").join(asked.hint("merge"), "query_id").join(docs.select("id", F.lower("text").alias("low")).hint("merge"), "id")
    held = pairs.select("query_id", F.explode(F.filter("keywords", lambda k: F.contains(F.col("low"), k))).alias("keyword")).groupBy("query_id").agg(F.count_distinct("keyword").alias("n"))
    own = asked.join(held.hint("merge"), "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.size("keywords")).alias("recall"))
    mean = own.agg(F.round(F.avg("recall"), 6).alias("mean_recall"))  # one row
    return own.crossJoin(F.broadcast(mean)).withColumn("verdict", verdict(F.col("mean_recall")))


def contradictions(reasons: DataFrame, policies: DataFrame, rules: DataFrame, policy_words: tuple[str, ...], rule_words: tuple[str, ...], rule_question: str = "", least: float = 0.0) -> DataFrame:
    """Reasons (reason_id, text, amount) whose nearest policy clause and nearest rule (each id, text) contradict each other.

    Two searches, each for every reason by itself: the clause must speak one of ``policy_words``, the rule one of
    ``rule_words``.  ``rule_question`` is put before a reason when rules are searched.  Empty reasons and those without an amount are left out.
    """
    from ..functions.predicates import any_keyword
    from .matching import text_matches

    asked = reasons.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("amount") != 0))

    def best(texts: DataFrame, question: Column, words: tuple[str, ...], name: str) -> DataFrame:
        own = asked.select("text", question.alias("_question"))
        names = texts.select(F.col("text").alias("name"), "id")
        # the first by similarity decides, whatever it says
        top = text_matches(own.select(F.col("_question").alias("text")), names, 1, least, ("id",)).filter(any_keyword(F.col("name"), words))
        return own.distinct().join(top.select(F.col("text").alias("_question"), F.col("id").alias(name)).hint("merge"), "_question").select("text", name)

    one = best(policies, F.col("text"), policy_words, "policy_id")
    two = best(rules, F.concat(F.lit(rule_question), F.col("text")), rule_words, "rule_id")
    return asked.join(one.hint("merge"), "text").join(two.hint("merge"), "text").select("reason_id", "policy_id", "rule_id", F.col("amount").cast("double").alias("amount"))


#: Characters of an excerpt.
EXCERPT = 300


def lookups(found: DataFrame, kind: Column) -> DataFrame:
    """query_id and content: what was found for each question (query_id, rank, text and, for rates, rate) as numbered citations, a list of rates, or excerpts.

    ``kind`` is regulation, rate or policy; other kinds and missing texts give no line, a question without lines no row.
    """
    short = F.when(F.length("text") > EXCERPT, F.concat(F.substring("text", 1, EXCERPT), F.lit("..."))).otherwise(F.col("text"))
    line = (
        F.when(kind == "regulation", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("text")))
        .when(kind == "rate", F.concat(F.lit("• "), F.col("text"), F.lit(": ₹"), F.format_number("rate", 0)))
        .when(kind == "policy", short)
    )
    per = found.select("query_id", "rank", line.alias("_line")).filter("_line IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_line"))).alias("_x"))
    return per.select("query_id", F.array_join(F.transform("_x", lambda x: x["_line"]), "\n").alias("content"))


def keyword_recall(answers: DataFrame) -> DataFrame:
    """answers: query_id, text of what was found, keywords.  The share of keywords that the text holds."""
    low = F.lower("text")
    hit = F.size(F.filter("keywords", lambda k: F.contains(low, k)))
    return answers.select("query_id", F.try_divide(hit.cast("double"), F.size("keywords").cast("double")).alias("recall"))


def verdict(mean: Column) -> Column:
    return F.when(mean >= 0.8, "excellent").when(mean >= 0.6, "good").when(mean >= 0.4, "needs improvement").otherwise("poor")

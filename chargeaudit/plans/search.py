"""Queries of similarity search over embeddings and texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.bridge import table


def _sides(spark, d):
    """Rows of label 0 ask; the others are the corpus."""
    e = table(spark, d, "embeddings")
    return e.filter("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.filter("label <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def knn_topk(spark, d):
    return S.nearest(*_sides(spark, d), n=3)


def knn_threshold(spark, d):
    return S.nearest(*_sides(spark, d), n=5, metric="cosine", least=0.2)


def best_of_two(spark, d):
    q, c = _sides(spark, d)
    halves = [c.filter(f"id % 2 = {i}") for i in (0, 1)]
    return S.best_of([S.nearest(q, h, 1, "cosine") for h in halves], 0.1)


def contradiction_join(spark, d):
    """Queries whose best hits in two collections both carry a small label."""
    q, c = _sides(spark, d)
    one, two = (S.nearest(q, c.filter(f"label {x} 5"), 1, "cosine").join(c.select("id", "label").hint("merge"), "id").filter("label IN (1, 2, 6, 7)") for x in ("<", ">="))
    return one.select("query_id", F.col("id").alias("policy_id")).join(two.select("query_id", F.col("id").alias("rule_id")).hint("merge"), "query_id")


def invalid_rejection(spark, d):
    """Queries whose best hit is too far to count."""
    q, c = _sides(spark, d)
    return S.nearest(q, c.filter("label = 3"), 1, "cosine").filter(F.col("similarity") < 0.3).select("query_id", "id", "similarity")


def text_knn(spark, d):
    """Documents near a benchmark passage, by TF-IDF vectors of both."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text").union(table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), "text"))
    vectors = S.text_vectors(docs, "key", 1 << 10).select("id", vector_to_array("features").alias("vec"))
    return S.near_join(vectors.filter("id LIKE 'b%'"), vectors.filter("id LIKE 'd%'"), 1.0)


def lsh_knn(spark, d):
    """Rows near those whose number is divisible by 100, of whatever label, but for themselves."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return S.near_join(e.filter("id % 100 = 0"), e, 1.2).filter("id <> other").withColumn("distance", F.round("distance", 6))


def keyword_recall(spark, d):
    """Recall of three words of each benchmark passage in the documents of the same number."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 4), 1, 3)
    asked = b.select(F.col("item_id").alias("query_id"), words.alias("keywords"))
    return S.keyword_recall(asked.join(docs.select(F.col("doc_id").alias("query_id"), "text"), "query_id").filter(F.size("keywords") > 0)).withColumn("verdict", S.verdict(F.col("recall")))


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_reduce(list_transform(range(1, 65), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE), lambda p, q: p + q)"
    return f"round({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 3)"


L2 = "round(1 - list_reduce(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)), lambda x, y: x + y), 3)"
COS = _cos("q.embedding", "c.embedding")
PAIRS = "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, {sim} AS similarity FROM embeddings q JOIN embeddings c ON q.label = 0 AND c.label <> 0)"
RANKED = PAIRS + ", r AS (SELECT query_id, id, label, similarity, (row_number() OVER (PARTITION BY query_id{part} ORDER BY similarity DESC, id))::INTEGER AS rank FROM s{where})"

QUERIES = {f.__name__: f for f in (knn_topk, knn_threshold, best_of_two, contradiction_join, invalid_rejection, text_knn, lsh_knn, keyword_recall)}
ORACLE_SQL = {
    "knn_topk": RANKED.format(sim=L2, part="", where="") + " SELECT query_id, id, similarity, rank FROM r WHERE rank <= 3",
    "knn_threshold": RANKED.format(sim=COS, part="", where="") + " SELECT query_id, id, similarity, rank FROM r WHERE rank <= 5 AND similarity >= 0.2",
    "best_of_two": RANKED.format(sim=COS, part=", id % 2", where="")
    + " SELECT query_id, id, similarity, rank, (id % 2)::INTEGER AS search FROM r WHERE rank = 1 AND similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id % 2) = 1",
    "contradiction_join": RANKED.format(sim=COS, part=", label < 5", where="")
    + " SELECT a.query_id, a.id AS policy_id, b.id AS rule_id FROM r a JOIN r b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 1 AND a.label < 5 AND b.label >= 5 WHERE a.label IN (1, 2) AND b.label IN (6, 7)",
    "invalid_rejection": RANKED.format(sim=COS, part="", where=" WHERE label = 3") + " SELECT query_id, id, similarity FROM r WHERE rank = 1 AND similarity < 0.3",
    "lsh_knn": "SELECT id, other, round(distance, 6) AS distance FROM (SELECT q.vec_id AS id, c.vec_id AS other, sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)))) AS distance FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id) WHERE distance < 1.2",
    "keyword_recall": """WITH a AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(b.text), '[^a-z]+'), lambda w: length(w) > 4)[1:3] AS k, d.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
r AS (SELECT query_id, len(list_filter(k, lambda w: contains(lower(text), w)))::DOUBLE / len(k) AS recall FROM a WHERE len(k) > 0)
SELECT query_id, recall, CASE WHEN recall >= 0.8 THEN 'excellent' WHEN recall >= 0.6 THEN 'good' WHEN recall >= 0.4 THEN 'needs improvement' ELSE 'poor' END AS verdict FROM r""",
}

"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  The first four return
the columns of ``documents``: rejected documents go, one document of each group of near-duplicates stays,
secrets are masked in the texts, and the mix repeats or leaves out whole documents so that sources meet their
targets.  The last returns the pieces of packed sequences.

Defined cases: a null, empty or blank text has too few words and goes with the quality rules; a null lang or source is a group
of its own; rows without doc_id are linked with no others; of rows that repeat id and text one stays after the near-duplicates, rows of one id
with different texts are documents of their own; long texts pass whole; an empty table gives an empty result; other columns of
``documents`` stay as they are up to the mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chargeaudit.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from chargeaudit.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", dedup),
    ("secret scans", secrets),
    ("mixing", mix),
    ("packing", pack),
]
#: Shingle sketches and a tokenizer are no SQL; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


QUERIES = {"pipeline": run}

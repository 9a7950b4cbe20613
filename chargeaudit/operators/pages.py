"""Operators on lines and pages of documents: filled headings, document boundaries, records, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, line (from 0) and text."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "text"))


def filled(rows: DataFrame, value: Column, key: str, order: str, name: str, default: str | None = None) -> DataFrame:
    """``value`` carried forward from the last row of the key that has one, else ``default``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(w)
    return rows.withColumn(name, F.coalesce(last, F.lit(default)) if default is not None else last)


def boundaries(pages: DataFrame, is_start: Column, key: str, order: str, most: int = 10) -> DataFrame:
    """Per document the parts that starting pages open: number, first and last page, and whether there are too many.

    Pages before the first start belong to no part; a document without a start is one part.
    """
    w = Window.partitionBy(key).orderBy(order)
    marked = pages.select(key, order, is_start.alias("_start"), F.count_if(is_start).over(Window.partitionBy(key)).alias("_n"), F.min(order).over(Window.partitionBy(key)).alias("_first"), F.max(order).over(Window.partitionBy(key)).alias("_last"))
    starts = marked.filter(F.col("_start") | ((F.col("_n") == 0) & (F.col(order) == F.col("_first"))))
    return starts.select(key, F.row_number().over(w).alias("part"), F.col(order).alias("first"), F.coalesce(F.lead(order).over(w) - 1, F.col("_last")).alias("last"), (F.col("_n") > most).alias("too_many"))


def records(lines: DataFrame, is_start: Column, key: str, order: str, text: str) -> DataFrame:
    """Runs of lines that a starting line opens, joined: key, record and text; lines before the first start are left out."""
    number = F.sum(is_start.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("record", number).filter("record > 0").groupBy(key, "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("joined"), F.count("*").alias("n_lines"))


def clusters(values: Column, width: float) -> Column:
    """Ordered values in groups: a group ends before the first value that is more than ``width`` above its first one."""
    start = F.struct(F.array().cast("array<struct<anchor:double,n:int>>").alias("done"), F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"))
    close = lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["anchor"].alias("anchor"), a["n"].alias("n")))).otherwise(a["done"])
    step = lambda a, x: F.when((a["n"] > 0) & (x - a["anchor"] <= width), F.struct(a["done"].alias("done"), a["anchor"].alias("anchor"), (a["n"] + 1).alias("n"))).otherwise(
        F.struct(close(a).alias("done"), x.alias("anchor"), F.lit(1).alias("n"))
    )
    return F.aggregate(F.array_sort(values), start, step, close)


def chunks(docs: DataFrame, limit: int, least: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines packed into chunks of at most ``limit`` characters: key, chunk, chunk_text and its length."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return docs.select(key, F.posexplode(X.packed(parts, limit)).alias("chunk", "chunk_text")).withColumn("chunk_chars", F.length("chunk_text"))

"""Shared helpers: reading tables, cutting lineage in the shared folder, size-checked joins, word codes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: the space and the five ASCII controls that ``bytes.split()`` splits at.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster gets an error, since
    no machine-local folder would do there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table; its files go when the frame is collected as garbage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.parquet(path)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``right`` if a count shows that it is small; else a sort-merge join, whose hot keys AQE splits."""
    hint = "broadcast" if right.limit(limit + 1).count() <= limit else "merge"
    return left.join(right.hint(hint), on, how)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most about ``most`` bytes of ``column`` (one row at least).

    Workers outlive their tasks, so what Arrow keeps in reserve is given back at the end.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        block = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


class WordCodes(dict):
    """Numbers words in the order in which they turn up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads integers over all 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial 64-bit hashes of all windows of ``width`` values."""
    n = len(values) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for j in range(width):
                out *= np.uint64(0xD6E8FEB86659FD93)
                out += values[j : j + n]
    return out


def has_columns(df: DataFrame, *names: str) -> None:
    if missing := [x for x in names if x not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


__all__ = ["BLANKS", "BROADCAST_ROWS", "F", "WORD", "WordCodes", "cut", "has_columns", "join_small", "mixed", "shared_folder", "slices", "table", "texts_of", "windows", "written"]

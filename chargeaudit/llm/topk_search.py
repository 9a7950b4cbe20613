"""Exact top-k search by inner product with vector-approximation files.

Components become floor(scale * x), whole numbers of any size.

1. The approximation file: for each vector a cell of a byte in every dimension, of a grid between the least and
   the highest value of that dimension; written once, beside the exact vectors.
2. Scan.  The file is dealt into chunks and the queries into query chunks, and every pair of chunks meets in one group.
   The cells' edges bound each inner product from above and below; what lies below a chunk's k-th lower bound goes.
   Of what all chunks leave, what lies below a query's k-th lower bound goes too.
3. Exact vectors are read for what is left alone, in falling order of the upper bounds: first some candidates
   for each query, then those whose upper bound reaches the k-th score found, which makes the result certain.

Of rows with one and the same vector only the k + 1 with the smallest vec_id enter the file, for no other can be among
the k best of any query, so a vector that many rows share costs no more than a rare one.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of
different lengths are not compared; rows with a null vec_id take no part; rows that repeat a vec_id are candidates
and queries each, and a query is not compared with its own row alone; ties go to the smaller vec_id; a score
beyond 64 bits is ranked as it is and shown as the nearest 64-bit number; a query without candidates has no row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, has_columns, join_small, table, written

K = 5
SCALE = 256
EVERY = 50
#: Vectors of a candidate chunk and of a query chunk, about.
CANDIDATES = 16384
QUERIES_PER_CHUNK = 1024
#: Cells of the grid in each dimension; a cell is a byte.
CELLS = 256
#: Candidates of a query that are read exactly at first.
STRETCH = 16
#: The range of the scores that are shown.
LONG = (-(1 << 63), (1 << 63) - 1)


def taking_part(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column as doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; endless where that has no double."""
    with np.errstate(over="ignore"):
        return np.floor(vectors.astype(np.float64) * scale)


def exact(x: np.ndarray, y: np.ndarray, scale: int = SCALE) -> list[int]:
    """Inner products of the scaled rows of ``x`` with those of ``y``, as whole numbers of any size."""
    a, b = scaled(x, scale), scaled(y, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        most = (np.abs(a) * np.abs(b)).sum(axis=1)
        quick = (a * b).sum(axis=1)
    whole = lambda v: floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale
    return [int(s) if m < 2.0**53 else sum(whole(p) * whole(q) for p, q in zip(u, v, strict=True)) for s, m, u, v in zip(quick.tolist(), most.tolist(), x.tolist(), y.tolist(), strict=True)]


class Grid:
    """The cells of vectors between the least and the highest scaled value of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, scale: int = SCALE) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self.low, self.scale = low.astype(np.float64), scale
            self.width = np.floor(np.nan_to_num((high - low) / CELLS, nan=np.inf, posinf=np.inf)) + 1

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.floor((scaled(vectors, self.scale) - self.low) / self.width)
        return np.clip(np.nan_to_num(at, nan=0.0), 0, CELLS - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products, (queries, vectors).

        A cell's edges are one width further apart than they need be and the slack covers rounding, so doubles will do;
        where they overflow nothing is known.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            bottom = self.low + (cells.astype(np.float64) - 1e-6) * self.width
            span = self.width * (1 + 2e-6)
            positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
            base = queries @ bottom.T
            edge = np.maximum(np.abs(self.low), np.abs(self.low + (CELLS + 1) * self.width))
            slack = np.abs(queries) @ edge * 2.0**-40
            low, high = base + (negative @ span - slack)[:, None], base + (positive @ span + slack)[:, None]
        return np.nan_to_num(low, nan=-np.inf, posinf=-np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf, neginf=np.inf)


def grids(rows: DataFrame, scale: int) -> DataFrame:
    """d, low and high: the least and highest scaled value in each dimension of the vectors of a length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.asarray(batch.column("d"))
            for d in np.unique(sizes).tolist():
                x = scaled(matrix(batch.column("v").filter(pa.array(sizes == d))), scale)
                low, high = found.get(d, (x[0], x[0]))
                found[d] = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if found:
            at = [pa.array([i for d in found for i in range(d)], pa.int32()), pa.array([d for d in found for _ in range(d)], pa.int32())]
            yield pa.RecordBatch.from_arrays([at[1], at[0], *[pa.array(np.concatenate([v[k] for v in found.values()])) for k in (0, 1)]], names=["d", "i", "low", "high"])

    edges = rows.select("d", "v").mapInArrow(work, "d int, i int, low double, high double").groupBy("d", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    per = edges.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("e"))  # as long as a vector
    return per.select("d", F.col("e.low").alias("low"), F.col("e.high").alias("high"))


def grid_of(table_: pa.Table | pa.RecordBatch, scale: int) -> Grid:
    return Grid(np.asarray(table_.column("low")[0].as_py(), np.float64), np.asarray(table_.column("high")[0].as_py(), np.float64), scale)


def approximated(rows: DataFrame, scale: int) -> DataFrame:
    """d, row and cells of each vector: the approximation file.  ``rows`` carries the grid of its length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("d"))
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                cells = grid_of(part, scale).cells(matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("row"), pa.array([c.tobytes() for c in cells], pa.binary())], names=["d", "row", "cells"])

    return rows.select("d", "row", "v", "low", "high").mapInArrow(work, "d int, row long, cells binary")


def scanned(file: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, scale: int) -> DataFrame:
    """q, row, lower and upper of the candidates that a chunk's bounds leave to a query."""
    spread = F.xxhash64("row")
    names = ["d", "c", "p", "row", "cells", "v", "low", "high"]
    none, nothing = F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("array<double>")
    candidate = join_small(file, sizes.select("d", "chunks", "parts"), "d").select(
        "d", F.pmod(spread, "chunks").cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "row", "cells", nothing.alias("v"), nothing.alias("low"), nothing.alias("high")
    )
    query = join_small(asked, sizes, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), F.pmod(spread, "parts").cast("int").alias("p"), "row", none, "v", "low", "high")

    def group(data: pa.Table) -> pa.Table:
        ask = pa.array(np.asarray(data.column("v").is_valid()))
        asked, others = data.filter(ask), data.filter(pc.invert(ask))
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and others.num_rows:
            grid = grid_of(asked, scale)
            cells = np.frombuffer(b"".join(others.column("cells").to_pylist()), np.uint8).reshape(others.num_rows, -1)
            rows, own, q = np.asarray(others.column("row")), np.asarray(asked.column("row")), scaled(matrix(asked.column("v")), scale)
            for i in range(0, len(q), 32):
                lower, upper = grid.bounds(q[i : i + 32], cells)
                for j in range(len(lower)):
                    live = rows != own[i + j]
                    n = int(live.sum())
                    if n > k:
                        live &= upper[j] >= np.partition(lower[j][live], n - k)[n - k]
                    at = np.flatnonzero(live)
                    out.append((np.full(len(at), own[i + j]), rows[at], lower[j][at], upper[j][at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table([pa.array(c) for c in columns], names=["q", "row", "lower", "upper"])

    return candidate.select(names).union(query.select(names)).groupBy("d", "c", "p").applyInArrow(group, "q long, row long, lower double, upper double")


def scored(pairs: DataFrame, vectors: DataFrame, scale: int) -> DataFrame:
    """query_id, q, vec_id, row, score, far and rest (which order scores of any size) of the pairs (q, row), from the exact vectors."""
    ends = pairs.select(F.explode(F.array("q", "row")).alias("_row")).distinct()
    read = written(join_small(vectors, ends, vectors["row"] == ends["_row"], "left_semi").select("row", "id", "v"), "vectors")
    own, other = (read.select(F.col("row").alias(r), F.col("id").alias(i), F.col("v").alias(v)) for r, i, v in (("q", "query_id", "x"), ("row", "vec_id", "y")))
    both = pairs.select("q", "row").join(own.hint("merge"), "q").join(other.hint("merge"), "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("x")))
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                found = exact(matrix(part.column("x")), matrix(part.column("y")), scale)
                far = [0 if LONG[0] <= s <= LONG[1] else (1 if s > 0 else -1) * s.bit_length() for s in found]
                # beyond 64 bits the order is that of the lengths in bits, then of the bytes
                rest = [b"" if not f else (s if f > 0 else s + (1 << -f)).to_bytes(-(-abs(f) // 8)) for s, f in zip(found, far, strict=True)]
                score = [min(max(s, LONG[0]), LONG[1]) for s in found]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("q", "query_id", "row", "vec_id")], pa.array(score, pa.int64()), pa.array(far, pa.int64()), pa.array(rest, pa.binary())], names=["q", "query_id", "row", "vec_id", "score", "far", "rest"])

    return both.select("q", "query_id", "row", "vec_id", "x", "y").mapInArrow(work, "q long, query_id long, row long, vec_id long, score long, far long, rest binary")


def search(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of ``vectors`` (vec_id, embedding) for each row that ``queries`` picks."""
    has_columns(vectors, "vec_id", "embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & taking_part(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("v"))
    # numbered before they are written, so that rows that repeat a vec_id stay apart
    rows = written(rows.select("*", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")), "vectors")
    first = F.row_number().over(Window.partitionBy("d", F.xxhash64("v"), "v").orderBy("id", "row"))
    few = rows.select("row", "id", "d", "v", first.alias("turn")).filter(F.col("turn") <= k + 1)
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).filter("q > 0")
    sizes = sizes.select("d", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("chunks"), F.ceil(F.col("q") / QUERIES_PER_CHUNK).cast("int").alias("parts"))
    sizes = cut(join_small(grids(rows, scale), sizes, "d"))  # one row for each length of vectors
    file = written(approximated(join_small(few.select("d", "row", "v"), sizes, "d"), scale), "cells")
    left = written(scanned(file, rows.filter("asks").select("d", "row", "v"), sizes, k, scale), "bounds")
    stretch = max(STRETCH, 2 * k)
    # the k-th lower bound over all chunks
    edge = left.select("q", "lower", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower"))).alias("turn")).filter(F.col("turn") == k).select("q", F.col("lower").alias("edge"))
    left = left.join(edge.hint("merge"), "q", "left").filter(F.col("edge").isNull() | (F.col("upper") >= F.col("edge")))
    left = cut(left.select("q", "row", "upper", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "row")).alias("turn")))
    order = Window.partitionBy("q").orderBy(F.desc("far"), F.desc("score"), F.desc("rest"), "vec_id", "row")
    early = cut(scored(left.filter(F.col("turn") <= stretch), rows, scale))
    sure = early.select("q", "score", F.row_number().over(order).alias("turn")).filter(F.col("turn") == k).select("q", F.col("score").cast("double").alias("sure"))
    # a double may lie above the score that it stands for; the slack gives way to that
    slack = F.abs("sure") * 2.0**-50
    late = cut(left.filter(F.col("turn") > stretch).join(sure.hint("merge"), "q").filter((F.col("upper") >= F.col("sure") - slack) | (F.abs("sure") >= 2.0**62)).select("q", "row"))
    found = early if late.isEmpty() else early.union(scored(late, rows, scale))
    top = found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
), r AS (SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op4_topk_search": op4_topk_search}
ORACLE_SQL = {"op4_topk_search": ORACLE}

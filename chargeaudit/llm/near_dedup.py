"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

Texts are lower-cased in A-Z and cut into words at the six ASCII blanks; a document is the set of its 5-word
shingles (all its words as one shingle if it has fewer).  Two documents are linked if their sets share at
least 75 % of their union.

1. One pass over the texts gives each document its set's size and fingerprint, BANDS * ROWS minima of universal
   hashes, cut to a byte each for verification, and one key per band of ROWS minima.
2. Equal sets form a class; only the smallest doc_id of a class goes on, so copies cost a row each.
3. Per band key the smallest document is the pivot and every other one is a candidate with it: as many pairs as
   rows, however large the bucket.  Pairs whose minima agree too little to reach the threshold are dropped, and
   the rest is confirmed on full sets, recomputed from the texts of candidates alone.
4. Components of the confirmed links by alternating large-star and small-star.
5. Buckets whose documents still lie in several components are open.  Documents that open buckets chain together
   form a cell.  In a cell all members outside its largest component are compared on full sets with all
   members, in blocks of bounded size, and a block returns a spanning forest of the links it finds.  So no
   pair of a bucket is left undecided unless a chain links it anyway, and no block emits more rows than it read.
6. Components again, of the old labels and the new links.

A pair at exactly 75 % is missed by all bands with probability (1 - 0.75 ** ROWS) ** BANDS, below 1e-5.
Sets are held as 64-bit hashes of shingles.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing, itself its component;
rows that repeat a doc_id with several texts keep their own sizes, and are one node that has the links of all
its texts; rows with a null doc_id are dropped from linking and form components of null; ties go to the
smaller doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCodes, cut, has_columns, join_small, slices, table, texts_of, windows, written

WORDS = 5
PERCENT = 75
BANDS = 32
ROWS = 4
#: Members of a cell that a block compares, outside and inside the largest component, about; and the bytes of their sets.
OUTSIDE = 512
MEMBERS = 2048
OUTSIDE_BYTES = 4 << 20
MEMBERS_BYTES = 16 << 20
#: Keys that the copies of a text are dealt over.
SALTS = 16
#: Agreement of the byte-sized minima below which a pair is not confirmed: over six standard deviations under the threshold.
LEAST_AGREEMENT = 0.52

_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Shingler:
    """Shingle sets of texts; word hashes are kept for the texts of one batch."""

    def __init__(self) -> None:
        self.codes = WordCodes()
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        words = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
        if not words:
            return np.zeros(0, np.uint64)
        known = len(self.codes)
        ids = self.codes.of(words)
        if len(self.codes) > known:
            new = list(islice(reversed(self.codes), len(self.codes) - known))[::-1]
            if len(self.codes) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(max(len(self.codes), 1024), np.uint64)])
            self.hashes[known : len(self.codes)] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        width = min(WORDS, len(words))
        return np.unique(windows(self.hashes[ids], width) + np.uint64(width))


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """For each universal hash (a x + b mod 2**64) the upper 32 bits of its minimum over the set."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), block):
            part = shingles[i : i + block]
            grid = _A[:, None] * part[None, :]
            grid += _B[:, None]
            np.minimum(low, grid.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


SKETCH = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType(), False),
        T.StructField("print", T.BinaryType(), False),
        T.StructField("sig", T.BinaryType(), False),
        T.StructField("bands", T.ArrayType(T.LongType()), False),
    ]
)


def sketched(docs: DataFrame) -> DataFrame:
    """id, set size, fingerprint, byte-sized minima and band keys of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingler, sizes, prints, sigs, bands = Shingler(), [], [], [], []
            for text in texts_of(batch, "text"):
                s = shingler(text)
                low = minima(s)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                rows = low.astype("<u4").reshape(BANDS, ROWS)
                bands.append([xxhash.xxh3_64_intdigest(rows[b].tobytes(), b) - (1 << 63) for b in range(BANDS)] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=SKETCH.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SKETCH)


def agreeing(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    sig = sketch.select("id", "n", "sig")
    a = sig.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sig.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    both = both.filter(((100 * F.least("na", "nb")) >= PERCENT * F.greatest("na", "nb")) & (F.col("a") != F.col("b")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT))

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long").distinct()  # an id may have several texts


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and s, the full shingle set, of the documents in ``ids``: one row for each different set of an id."""
    wanted = join_small(docs, ids.select(F.col("id").alias("_id")), docs["doc_id"] == F.col("_id"), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingler = Shingler()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingler(t).tobytes() for t in texts_of(batch, "text")], pa.binary())], names=["id", "s"])

    return written(wanted.select("doc_id", "text").mapInArrow(work, "id long, s binary"), "sets", "snappy").dropDuplicates(["id", "s"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share at least PERCENT of their union."""
    full = full_sets(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b").join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "sa"), "sb"):
            ok = []
            for p, q in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each end of an edge reaches, by alternating large-star and small-star."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        # large-star: larger neighbours move to the smallest of the neighbourhood
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours, and the node itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (bucket, id) with the component of each id."""
    return rows.join(found.withColumnRenamed("component", "c").hint("merge"), "id", "left").select("bucket", "id", F.coalesce("c", "id").alias("c"))


def open_rows(rows: DataFrame) -> DataFrame:
    """Those rows (bucket, id, c) whose bucket holds several components."""
    many = rows.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("bucket")
    return rows.join(many.hint("merge"), "bucket", "left_semi")


def shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of all sets in ``x`` with all in ``y``, by products of 0/1 matrices, ``width`` shingles at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    xs, ys = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (x, y))
    both = np.intersect1d(xs, ys)
    marks = []
    for values, sets in ((xs, x), (ys, y)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, values)
        hit = (at < len(both)) & (both[np.minimum(at, max(len(both) - 1, 0))] == values) if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        marks.append((row[hit][order], at[hit][order], len(sets)))
    for low in range(0, len(both), width):
        parts = []
        for row, at, n in marks:
            a, b = np.searchsorted(at, [low, low + width])
            m = np.zeros((n, min(width, len(both) - low)), np.float32)
            m[row[a:b], at[a:b] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def forest(data: pa.Table) -> pa.Table:
    """Links that join components of one block: rows (outside, id, c, s), each outside row against each other row."""
    out = np.asarray(data.column("outside"))
    ids, c = np.asarray(data.column("id")), data.column("c").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in data.column("s").to_pylist()]
    x, y = np.flatnonzero(out), np.flatnonzero(~out)
    found: list[tuple[int, int]] = []
    if len(x) and len(y):
        both = shared([sets[i] for i in x], [sets[i] for i in y])
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        linked = 100 * both >= PERCENT * (sizes[x][:, None] + sizes[y][None, :] - both)
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for i, j in np.argwhere(linked):
            p, q = top(c[x[i]]), top(c[y[j]])
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((int(ids[x[i]]), int(ids[y[j]])))
    columns = list(zip(*found, strict=True)) or [(), ()]
    return pa.table([pa.array(v, pa.int64()) for v in columns], names=["a", "b"])


def cell_links(todo: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components in the open rows ``todo`` (bucket, id, c)."""
    low = todo.groupBy("bucket").agg(F.min("id").alias("a"))
    cells = components(todo.join(low.hint("merge"), "bucket").select("a", F.col("id").alias("b")).filter("a <> b").distinct())
    members = todo.select("id", "c").distinct()
    full = full_sets(docs, members.select("id"))
    weights = full.groupBy("id").agg(F.sum(F.octet_length("s")).alias("w"))
    cell = members.join(cells.hint("merge"), "id", "left").select("id", "c", F.coalesce("component", "id").alias("cell")).join(weights.hint("merge"), "id")
    sizes = cell.groupBy("cell", "c").agg(F.count("*").alias("n"), F.sum("w").alias("w")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "c", "w")).alias("most"))
    blocks = lambda n, w, rows, size: F.greatest(F.ceil(n / rows), F.ceil(w / size), F.lit(1)).cast("int")
    sizes = sizes.select("cell", blocks(F.col("n"), F.col("w"), MEMBERS, MEMBERS_BYTES).alias("chunks"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"), OUTSIDE, OUTSIDE_BYTES).alias("parts"), F.col("most.c").alias("largest"))
    rows = cut(cell.join(sizes.hint("merge"), "cell"))
    draw = F.xxhash64("id")
    inside = rows.select("cell", F.pmod(draw, "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("outside"), "id", "c")
    out = rows.filter("c <> largest").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(draw, "parts").cast("int").alias("part"), F.lit(True).alias("outside"), "id", "c")
    both = inside.union(out).join(full.hint("merge"), "id")
    return both.select("cell", "chunk", "part", "outside", "id", "c", "s").groupBy("cell", "chunk", "part").applyInArrow(forest, "a long, b long")


def links(sketch: DataFrame, docs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """id, component of the class representatives in ``sketch`` that are linked with another; ``own``: links (a, b) known before."""
    rows = sketch.select("id", F.explode("bands").alias("bucket"))
    pivot = rows.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("size")).filter("size > 1").select("bucket", "a")
    rows = written(rows.join(pivot.hint("merge"), "bucket").select("bucket", "id", "a"), "buckets").filter("id <> a")
    pairs = rows.select("a", F.col("id").alias("b")).distinct()
    sure = confirmed(cut(agreeing(pairs, sketch)), docs)
    found = components(sure if own is None else sure.union(own))
    # pivots' pairs are decided; what is left of a bucket is open if it lies in several components
    todo = cut(open_rows(labelled(rows.select("bucket", "id"), found)))
    if todo.isEmpty():
        return found
    more = cell_links(todo, docs)
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    has_columns(docs, "doc_id", "text")
    sketch = written(sketched(docs), "minhash")
    full = sketch.filter("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # copies of one text may be a large part of the rows, so they are dealt over SALTS keys
    shared = classes.filter("copies > 1").select("print", "rep", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = sketch.select("id", "n", "print", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    every = cut(salted.join(shared.hint("merge"), ["print", "salt"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    reps = classes.select("print", F.col("rep").alias("id"))
    distinct = full.join(reps.hint("merge"), ["print", "id"], "left_semi").dropDuplicates(["id", "print"])
    # an id with several texts is one node with the links of all of them
    mark = F.xxhash64("print")
    several = full.groupBy("id").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).filter("x <> y").select(F.col("id").alias("a"))
    own = cut(every.filter("n > 0").join(several.hint("merge"), every["id"] == several["a"]).select("a", F.col("rep").alias("b")).distinct())
    found = links(distinct, docs.select("doc_id", "text"), None if own.isEmpty() else own).withColumnRenamed("id", "rep")
    return every.join(found.hint("merge"), "rep", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "rep"), F.lit(True)).alias("kept")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which no near-duplicate has a smaller doc_id, with their columns as they are.

    Rows that repeat both doc_id and text stay once.
    """
    keep = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS u(i)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN c ON c.d = documents.doc_id
"""

QUERIES = {"op1_near_dedup": op1_near_dedup}
ORACLE_SQL = {"op1_near_dedup": ORACLE}

"""Alignment of two tokenizers' tokens by whitespace-token anchors, and how often two ids meet in a corpus.

Each text is tokenised whole by both: byte-level pieces (A) of a space and the text, and pieces with byte fallback (B) of the
text, to which that tokenizer adds the space itself.  Both give the same bytes, or the text has no tokens.  An anchor is
a byte offset at which a token of A and one of B end, as their summed lengths show, and after which both go on with a
token that begins with a space, or with nothing.  Between anchors lie windows of token ids, mostly one word each, and a window is
aligned once: a worker keeps what it found under the pair of id tuples in a table of bounded size.  Groups end where both end;
a link is a pair of tokens whose bytes overlap.

A task sums a document's links by pair of ids, so a document gives one row for each pair that it holds.  The counts of
all pairs are summed over the corpus, and the highest count of each B id has at most as many rows as B has ids.  Counts go
back to the documents in two parts: those of the COMMON most frequent pairs, a list of fixed length, are broadcast; the rest are joined by
a shuffle, in which no key is frequent.

Texts of more than CHUNK characters are encoded in parts, cut at single spaces between other characters, where
both tokenizers always end a token (neither vocabulary has a piece with a space behind another character); what spans
no such place stays one part.

Defined cases: a null or empty text, and one whose bytes differ from the tokens' (such as one with the sign that stands for a space in
B), has zeros and an empty digest; special tokens' strings are plain text; repeated rows count each; a null doc_id stays
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_columns, slices, table, texts_of, written
from .packing import byte_letters

#: Pairs whose counts are broadcast.
COMMON = 50_000
#: Characters of a text that are encoded at a time, about.
CHUNK = 100_000
#: Bytes of text of a batch.
AT_ONCE = 1 << 19
#: Windows and links in a worker's table; what a batch adds comes on top.
KEPT = 400_000
KEPT_LINKS = 3_000_000
#: Bits of ids of A and B in a pair; a batch numbers its documents above them.
A_BITS, B_BITS = 20, 20  # over 100,000 ids each
LOW = (1 << B_BITS) - 1

#: As wide as Latin letters and signs go.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def parts(text: str, size: int = CHUNK) -> list[str]:
    """The text cut before single spaces, each part of about ``size`` characters; every part but the first begins with that space."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Tokenizers:
    """Both tokenizers, and of each id its bytes, their number, and whether they begin with a space.

    Texts of PLAIN characters alone, on whose classes all versions of Unicode agree, are encoded by A's vocabulary as ranks, which gives
    the same ids in a quarter of the time.
    """

    def __init__(self, a: str | None, b: str | None, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        if a is None:
            a, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path("piece_bpe_32k.model"))
        self.a.encode_special_tokens = True
        self.plain = None
        if ranks is not None:
            with open(ranks, "rb") as f:
                self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, special_tokens={})
        byte = {letter: value for value, letter in byte_letters().items()}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(byte.__getitem__, t)) if set(t) <= byte.keys() else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([t.startswith(b" ") for t in x]) for x in (self.a_bytes, self.b_bytes))

    def encode_a(self, text: str) -> list[int]:
        if self.plain is not None and PLAIN.fullmatch(text):
            return self.plain.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of each text behind a space, and by B."""
        cut = [parts(t) for t in texts]
        # A gets the parts as they are, for the first follows a space and the others begin with it; B adds that space itself
        a = iter([self.encode_a(x if i else f" {x}") for ps in cut for i, x in enumerate(ps)])
        b = iter(self.b.encode([x[1:] if i else x for ps in cut for i, x in enumerate(ps)], num_threads=1))
        whole = lambda ids, n: next(ids) if n == 1 else list(chain.from_iterable(islice(ids, n)))
        return [whole(a, len(ps)) for ps in cut], [whole(b, len(ps)) for ps in cut]

    def same(self, text: bytes, a: list[int], b: list[int]) -> bool:
        whole = b" " + text
        return b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole


def grown(values: np.ndarray, more: np.ndarray, used: int) -> np.ndarray:
    """An array with room for ``more`` behind the first ``used`` values, and these put there."""
    if used + len(more) > len(values):
        values = np.concatenate([values[:used], np.zeros(used + 2 * len(more), values.dtype)])
    values[used : used + len(more)] = more
    return values


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``most``, a row each, and how many they are."""
    names = np.array([str(i) for i in range(most)], "S")
    return names.view(np.uint8).reshape(most, -1), np.char.str_len(names).astype(np.int64)


_DIGITS = digits(100_000)


def grouped(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, last: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of all groups, whose ids end before ``a_last`` and ``b_last``, with a line for each window, whose groups end before ``last``."""
    n_a, n_b = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0)
    start = np.cumsum(n_a + n_b) - n_a - n_b
    places = [np.repeat(first - (end - n), n) + np.arange(end[-1]) for first, end, n in ((start, a_last, n_a), (start + n_a, b_last, n_b))]
    ids = np.empty(len(a) + len(b), np.int64)
    sign = np.full(len(ids), ord(","), np.uint8)
    ids[places[0]], ids[places[1]] = a, b
    ends = start + n_a + n_b - 1
    sign[start + n_a - 1], sign[ends], sign[ends[last - 1]] = ord("|"), ord(";"), ord("\n")
    table, sizes = _DIGITS
    size = sizes[ids] + 1
    stop = np.cumsum(size)
    row = np.repeat(np.arange(len(ids)), size)
    column = np.arange(stop[-1]) - np.repeat(stop - size, size)
    out = table[ids[row], np.minimum(column, table.shape[1] - 1)]
    out[stop - 1] = sign
    return out.tobytes()


#: Between the ids of A and those of B of a window, and behind each window; no id has a last byte but 0.
MARK, BREAK = 0xFEFFFFFF, 0xFFFFFFFF
BREAK_BYTES = BREAK.to_bytes(4, "little")


def tuples(x: np.ndarray, y: np.ndarray, x_last: np.ndarray, y_last: np.ndarray) -> list[bytes]:
    """The id tuples of windows, whose ids end before ``x_last`` and ``y_last``: four bytes an id, MARK between both sides."""
    n_x, n_y = np.diff(x_last, prepend=0), np.diff(y_last, prepend=0)
    size = n_x + n_y + 2
    start = np.cumsum(size) - size
    ids = np.empty(len(x) + len(y) + 2 * len(size), "<u4")
    ids[np.repeat(start - (x_last - n_x), n_x) + np.arange(len(x))] = x
    ids[start + n_x] = MARK
    ids[np.repeat(start + n_x + 1 - (y_last - n_y), n_y) + np.arange(len(y))] = y
    ids[start + size - 1] = BREAK
    return ids.tobytes().split(BREAK_BYTES)[:-1]


class Windows(dict):
    """Windows met so far, by their tuples of ids: a number, under which is kept what each is aligned to."""

    def __init__(self, by: Tokenizers) -> None:
        super().__init__()
        self.by = by
        self.texts: list[bytes] = []
        self.groups, self.starts, self.links = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.used = 0

    def of(self, keys: list[bytes]) -> list[int]:
        """The windows' numbers; new ones are aligned first."""
        codes = list(map(self.get, keys))
        if None in codes:
            new = list(dict.fromkeys(k for k, c in zip(keys, codes, strict=True) if c is None))
            known = len(self)
            self.align(new)
            self.update(zip(new, range(known, known + len(new)), strict=True))
            codes = list(map(self.__getitem__, keys))
        return codes

    def align(self, keys: list[bytes]) -> None:
        """Groups and links of windows, which stand behind each other: their bytes are the same on both sides."""
        by, known = self.by, len(self.texts)
        ids = np.frombuffer(BREAK_BYTES.join(keys), "<u4")
        mark, stop = ids == MARK, ids == BREAK
        side = np.cumsum(mark) - np.cumsum(stop)
        of_a = (side == 0) & ~stop
        a, b = ids[of_a].astype(np.int64), ids[(side == 1) & ~mark].astype(np.int64)
        a_end, b_end = np.cumsum(by.a_size[a]), np.cumsum(by.b_size[b])
        last_a = np.cumsum(of_a)[mark]
        end = a_end[last_a - 1]
        # two tokens overlap in one stretch of bytes, up to the next end of either
        both = np.sort(np.concatenate([a_end, b_end]))
        ends = both[np.flatnonzero(np.diff(both, prepend=-1))]
        links = a[np.searchsorted(a_end, ends)] << B_BITS | b[np.searchsorted(b_end, ends)]
        link_last = np.searchsorted(ends, end) + 1
        shared, i, j = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        group_last = np.searchsorted(shared, end) + 1
        self.texts += grouped(a, b, i + 1, j + 1, group_last).split(b"\n")[:-1]
        self.groups = grown(self.groups, np.diff(group_last, prepend=0), known)
        self.links = grown(self.links, links, self.used)
        self.starts = grown(self.starts, np.concatenate([[self.used], self.used + link_last]), known)
        self.used += len(links)


class Aligner:
    """Documents' groups and links, with a bounded table of windows met so far."""

    def __init__(self, by: Tokenizers) -> None:
        if max(len(by.a_bytes), len(by.b_bytes)) > len(_DIGITS[1]):
            raise ValueError("too many ids")
        self.by, self.known = by, Windows(by)

    def __call__(self, texts: list[bytes | None]) -> list[tuple]:
        """Rows of ALIGNED, without doc_id."""
        if len(self.known) > KEPT or self.known.used > KEPT_LINKS:
            self.known = Windows(self.by)
        by, known = self.by, self.known
        rows: list[tuple] = [(0, 0, 0, 0, "", (), ())] * len(texts)
        held = [i for i, text in enumerate(texts) if text]
        both = zip(held, *by.encode([texts[i].decode() for i in held]), strict=True)
        full = [(i, a, b) for i, a, b in both if by.same(texts[i], a, b)]
        if not full:
            return rows
        a_last, b_last = np.cumsum([len(a) for _, a, _ in full]), np.cumsum([len(b) for _, _, b in full])
        x = np.fromiter(chain.from_iterable(a for _, a, _ in full), np.uint32, int(a_last[-1]))
        y = np.fromiter(chain.from_iterable(b for _, _, b in full), np.uint32, int(b_last[-1]))
        # texts stand behind each other, and each has the same bytes on both sides, so ends can be compared all at once
        _, i, j = np.intersect1d(np.cumsum(by.a_size[x]), np.cumsum(by.b_size[y]), assume_unique=True, return_indices=True)
        i, j = i + 1, j + 1
        stop = np.searchsorted(i, a_last)  # every text ends where both end
        anchor = by.a_space[x[np.minimum(i, len(x) - 1)]] & by.b_space[y[np.minimum(j, len(y) - 1)]]
        anchor[stop] = True
        at = np.flatnonzero(anchor)
        codes = known.of(tuples(x, y, i[at], j[at]))
        number = np.array(codes, np.int64)
        last = np.searchsorted(at, stop) + 1
        first = np.concatenate([[0], last[:-1]])
        groups = np.add.reduceat(known.groups[number], first)
        size = known.starts[number + 1] - known.starts[number]
        doc = np.repeat(np.repeat(np.arange(len(full)), last - first), size)
        key = np.sort(doc << A_BITS + B_BITS | gathered(known.links, known.starts[number], size))
        new = np.flatnonzero(np.diff(key, prepend=-1))
        pairs, counts = key[new] & ((1 << A_BITS + B_BITS) - 1), np.diff(new, append=len(key))
        cut = np.searchsorted(key[new] >> A_BITS + B_BITS, np.arange(len(full) + 1))
        for k, ((row, a, b), p, q) in enumerate(zip(full, first.tolist(), last.tolist(), strict=True)):
            digest = hashlib.sha256(b";".join(map(known.texts.__getitem__, codes[p:q]))).hexdigest()
            own = slice(cut[k], cut[k + 1])
            rows[row] = len(a), len(b), int(groups[k]), int(counts[own].sum()), digest, pairs[own], counts[own]
        return rows


_aligners: dict[tuple, Aligner] = {}


def aligner(a: str | None, b: str | None, ranks: str | None) -> Aligner:
    if (a, b, ranks) not in _aligners:
        _aligners[a, b, ranks] = Aligner(Tokenizers(a, b, ranks))
    return _aligners[a, b, ranks]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the groups' digest, and how often it links each pair of ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b, ranks)
        for batch in slices(batches, "text", AT_ONCE):
            columns = list(zip(*align(texts_of(batch, "text")), strict=True))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (A id and B id in one number), count, and whether that is the highest of its B id."""
    counts = written(rows.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy("pairs").agg(F.sum("counts").alias("count")), "pairs")
    highest = counts.groupBy(F.col("pairs").bitwiseAND(LOW).alias("_b")).agg(F.max("count").alias("_most"))
    both = counts.join(highest.hint("broadcast"), counts["pairs"].bitwiseAND(LOW) == highest["_b"])  # at most one row for each id of B
    return both.select(F.col("pairs").alias("pair"), "count", (F.col("count") == F.col("_most")).alias("best"))


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None, ranks: str | None = None, common: int = COMMON) -> DataFrame:
    """Numbers of tokens, groups and links, and what the links' counts say, for every row of ``docs`` (doc_id, text)."""
    has_columns(docs, "doc_id", "text")
    rows = written(aligned(docs, a, b, ranks).withColumn("_row", F.monotonically_increasing_id()), "aligned", "lz4")
    counts = written(pair_counts(rows), "counts")
    frequent = written(counts.orderBy(F.desc("count"), "pair").limit(common), "common")
    each = rows.select("_row", F.inline(F.arrays_zip("pairs", "counts"))).withColumnsRenamed({"pairs": "_pair", "counts": "_n"})
    some = each.join(frequent.hint("broadcast"), each["_pair"] == frequent["pair"], "left")
    rare = some.filter("pair IS NULL").select("_row", "_pair", "_n")
    rare = rare.join(counts.hint("merge"), rare["_pair"] == counts["pair"])
    sums = lambda df: df.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_n")).otherwise(0)).alias("n_best"), F.sum(F.col("_n") * F.col("count")).alias("count_sum"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own]
    zero = F.lit(0).cast("long")
    found = [sums(x).select("_row", *none, "n_best", "count_sum") for x in (some.filter("pair IS NOT NULL"), rare)]
    every = rows.select("_row", *own, zero.alias("n_best"), zero.alias("count_sum")).unionByName(found[0]).unionByName(found[1])
    one = every.groupBy("_row").agg(*[F.max(c).alias(c) for c in own], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return one.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}

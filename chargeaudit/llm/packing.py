"""Packing documents into training sequences along a space-filling curve.

Each document's counts of longer words are a hashed vector; a sign projection by the words' hashes brings it to
DIMENSIONS numbers, the normal distribution function to BITS-bit coordinates, and the Hilbert index of these is its key.  The
tokens are written out once, range-sorted by (key, doc_id), and every partition cuts its stream of documents
every ``width`` tokens, so a sequence holds neighbours on the curve.  Long documents are several rows of the sort.  What is left at a partition's end is cut
at powers of two, so no sequence needs padding.  Equal keys (copies) are told apart by doc_id and position, so
a large group of copies spreads over partitions.

A document's ids are those of the tokenizer for its whole text, without special tokens, then END.  Words
between blanks are encoded apart from each other, which changes nothing in this tokenizer (it drops blanks).
Its added tokens, such as <|endoftext|>, keep their own ids where a text holds them; texts are split there first.  Each worker keeps a bounded table of word encodings.

Defined cases: a null, empty or blank text has END alone; repeated rows are packed each; a null doc_id keeps
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, has_columns, slices, table, texts_of, written

WIDTH = 2048
END = 1
LEAST_BYTES = 4
DIMENSIONS = 4
BITS = 12
#: A worker's table of encodings holds at most about so many words, and bytes of words and ids; workers outlive tasks.
WORDS_KEPT = 200_000
BYTES_KEPT = 24 << 20
#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 20
#: Tokens of a row of the range sort at most; longer documents have several rows, so rows and bytes are alike.
SEGMENT = 2048
#: Tokens for a partition of the range sort.
PARTITION_TOKENS = 4 << 20

#: Texts of these characters alone are lower-cased and cut here as the tokenizer does it.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-įĲ-ɏ]*")
#: A sign that stands alone between a letter and a blank is a word of its own.
_SIGN = re.compile(r"[.,;:!?](?=[\t-\r ]|\Z)(?<=[^\W\d_].)", re.S)
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def words_of(text: bytes) -> list[bytes]:
    """Words that can be encoded apart: between blanks, and in plain texts lower-cased and without a last sign."""
    plain = text.decode()
    return _SIGN.sub(r" \g<0>", plain.lower()).encode().split() if _PLAIN.fullmatch(plain) else text.split()


#: For each value of a word's bits what it adds: a sign in each dimension and 1, or nothing where the weight is 0.
_KINDS = np.array([[(2 * (k >> d & 1) - 1) * (k >> DIMENSIONS) for d in range(DIMENSIONS)] + [k >> DIMENSIONS] for k in range(2 << DIMENSIONS)])
#: Stands at a text's end among its words; no word holds a blank.
STOP = b" "


class Encoder:
    """Token ids of texts, with a bounded table of the words met so far."""

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: added tokens among words, after a blank, which no word holds: words in lower case may look like them
        self.added = {b" " + t.encode(): i for t, i in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True)) + b")") if added else None
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words = WordCodes()
        # of each word: how often it was met; and its signs, number of ids and their start, packed into one number
        self.seen, self.packed = (np.zeros(1 << 16, np.int64) for _ in range(2))
        self.flat, self.filled, self.held = np.zeros(1 << 18, np.uint32), 0, 0

    def split(self, text: bytes) -> list[bytes]:
        """The words of a text, cut at added tokens."""
        if self.cuts is None or self.cuts.search(text) is None:
            return words_of(text)
        return [w for i, x in enumerate(self.cuts.split(text)) for w in ([b" " + x] if i % 2 else words_of(x))]

    def part(self, text: str) -> bytes:
        """Ids of one lower-cased part between cuts, four bytes each."""
        return array("I", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, text.encode())))]).tobytes()

    def word(self, word: bytes) -> bytes:
        if word == STOP:
            return array("I", [END]).tobytes()
        if word in self.added:
            return array("I", [self.added[word]]).tobytes()
        if word.isalpha():  # bytes: ASCII letters alone
            return self.part(word.lower().decode())
        text = word.decode()
        if _PLAIN.fullmatch(text) is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if text.isalpha():
            return self.part(text)
        return b"".join(map(self.part, _PARTS.findall(text)))

    def learn(self, words: list[bytes], at: int) -> None:
        """Encodes words whose codes begin with ``at``."""
        end = at + len(words)
        found = list(map(self.word, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total = int(sizes.sum())
        while end > len(self.seen):
            self.seen, self.packed = (np.concatenate([x, np.zeros_like(x)]) for x in (self.seen, self.packed))
        while self.filled + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : self.filled + total] = np.frombuffer(b"".join(found), np.uint32)
        self.packed[at:end] = (self.filled + np.cumsum(sizes) - sizes) << 30 | sizes << 5 | signs(words)
        self.seen[at:end] = 0
        self.filled += total
        self.held += sum(map(len, words))

    def forget(self) -> None:
        """Words met once go; if that is too little, all go.  The arrays shrink to what is left."""
        kept = [(w, at) for w, at in self.words.items() if self.seen[at] > 1]
        held = sum(len(w) for w, _ in kept)
        packed = self.packed[[at for _, at in kept]] if kept else np.zeros(0, np.int64)
        sizes = packed >> 5 & 0x1FFFFFF
        if len(kept) > WORDS_KEPT // 2 or held + 4 * int(sizes.sum()) > BYTES_KEPT // 2:
            kept, held, packed, sizes = [], 0, packed[:0], sizes[:0]
        ids = self.gather(packed >> 30, sizes)
        self.flat, self.filled, self.held = np.zeros(max(1 << 18, 2 * len(ids)), np.uint32), len(ids), held
        self.flat[: len(ids)] = ids
        self.seen, self.packed = (np.zeros(max(1 << 16, 2 * len(kept)), np.int64) for _ in range(2))
        self.packed[: len(kept)] = (np.cumsum(sizes) - sizes) << 30 | packed & 0x3FFFFFFF
        self.words = WordCodes(zip((w for w, _ in kept), range(len(kept)), strict=True))

    def gather(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, END after each text; each text's number of ids; each text's projected vector and its squared length."""
        if len(self.words) > WORDS_KEPT or self.held + 4 * self.filled > BYTES_KEPT:
            self.forget()
        split = [[*self.split(t or b""), STOP] for t in texts]
        each = np.array([len(ws) for ws in split], np.int64)
        known = len(self.words)
        codes = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(each.sum()))
        self.learn(list(islice(reversed(self.words), len(self.words) - known))[::-1], known)
        used = np.bincount(codes, minlength=len(self.words))
        self.seen[: len(used)] += used
        packed = self.packed[codes]
        sizes = packed >> 5 & 0x1FFFFFF
        ids = self.gather(packed >> 30, sizes)
        last = np.cumsum(each)
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[last], prepend=0)
        kinds = 2 << DIMENSIONS
        kind = np.repeat(np.arange(len(texts)) * kinds, each) + (packed & (kinds - 1))
        return ids, lengths, np.bincount(kind, minlength=len(texts) * kinds).reshape(-1, kinds) @ _KINDS


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def signs(words: list[bytes]) -> np.ndarray:
    """DIMENSIONS bits of each word's hash, and above them its weight: 0 for words under LEAST_BYTES, which are much alike everywhere."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
    weights = np.fromiter((len(w) >= LEAST_BYTES for w in words), np.int64, len(words))
    return hashes & ((1 << DIMENSIONS) - 1) | weights << DIMENSIONS


def coordinates(projected: np.ndarray) -> np.ndarray:
    """Places in DIMENSIONS coordinates of BITS bits; signs of words add up like a normal variable."""
    unit = projected[:, :DIMENSIONS] / np.sqrt(np.maximum(projected[:, DIMENSIONS:], 1))
    share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(unit / math.sqrt(2)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points (n, d), by inverse undoing, Gray coding and interleaving."""
    x = points.T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, doc_tokens, key and, for each segment of a row, start, n and ids (little-endian, two bytes each where the vocabulary allows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        size = encode.tokenizer.get_vocab_size()
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for batch in slices(batches, "text", AT_ONCE):
            ids, lengths, projected = encode(texts_of(batch, "text"))
            raw, width = memoryview(ids.astype(kind).tobytes()), np.dtype(kind).itemsize
            ends = np.cumsum(lengths)
            keys = hilbert(coordinates(projected))
            count = -(-lengths // SEGMENT)
            row = np.repeat(np.arange(len(lengths)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
            size = np.minimum(lengths[row] - start, SEGMENT)
            at = (ends - lengths)[row] + start
            cut = [raw[a * width : (a + n) * width] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(lengths[row]), pa.array(keys[row]), pa.array(start), pa.array(size), pa.array(cut, pa.binary())], names=["doc_id", "doc_tokens", "key", "start", "n", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, doc_tokens long, key long, start long, n long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cuts one partition's stream of (doc_id, doc_tokens, start, n, ids); what stays open is at most one sequence."""
    number = TaskContext.get().partitionId() << 32
    open_rows: list[tuple] = []  # doc_id, start, bytes, doc_tokens of the sequence that is being filled
    used = 0
    out: list[tuple] = []

    def close(rows: list[tuple]) -> None:
        nonlocal number
        offset = 0
        for doc_id, start, ids, tokens in rows:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), tokens, number, offset))
            offset += n
        number += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    for given in slices(batches, "ids"):
        for doc_id, tokens, first, size, raw in zip(*(given.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "n", "ids")), strict=True):
            kind = "<u2" if len(raw) == 2 * size else "<u4"
            ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
            at = 0
            while at < size:
                n = min(width - used, size - at)
                part = ids[4 * at : 4 * (at + n)]
                last = open_rows[-1] if open_rows else None
                if last and last[0] == doc_id and last[3] == tokens and last[1] + len(last[2]) // 4 == first + at:
                    open_rows[-1] = (doc_id, last[1], last[2] + part, tokens)  # goes on where the segment before it ended
                else:
                    open_rows.append((doc_id, first + at, part, tokens))
                at, used = at + n, used + n
                if used == width:
                    close(open_rows)
                    open_rows, used = [], 0
        if out:
            yield batch()
    while used:
        most = 1 << (used.bit_length() - 1)  # the largest power of two that fits
        rows, rest, have = [], [], 0
        for doc_id, start, ids, tokens in open_rows:
            n = min(len(ids) // 4, most - have)
            if n:
                rows.append((doc_id, start, ids[: 4 * n], tokens))
            if 4 * n < len(ids):
                rest.append((doc_id, start + n, ids[4 * n :], tokens))
            have += n
        close(rows)
        open_rows, used = rest, used - most
    if out:
        yield batch()


def pack(docs: DataFrame, width: int = WIDTH, path: str | None = None) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text)."""
    has_columns(docs, "doc_id", "text")
    tokens = written(tokenized(docs, path), "tokens", "lz4")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PARTITION_TOKENS))
    # rows may share even doc_id and start; a last column lets the ranges split them
    order = ["key", "doc_id", "start", "spread"]
    ranged = tokens.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "doc_tokens", "start", "n", "ids").mapInArrow(lambda b: pieces(b, width), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}

"""WARC archives: writing page records and reading them back with segment reassembly.

Writing.  Every page becomes a record.  Of pages with equal payloads of at least ``least`` bytes that with the
largest page_id is a ``response`` and the others are ``revisit`` records without payload; all else is a
response.  A response's block is an HTTP message in chunked transfer framing; a block longer than ``segment``
bytes is cut into a first record and ``continuation`` records that name the first by WARC-Segment-Origin-ID, are
numbered, and end with WARC-Segment-Total-Length.  Spark's text writer lays the records out, gzipped, in the
shared folder; its line separator is the blank line that ends a WARC record.

Reading.  Archive files, which hold at most RECORDS records of at most ``segment`` bytes and their headers, are unzipped and parsed
as streams, by Content-Length.  Segments meet by origin identifier, are ordered by
segment number and must be gapless and add up to the total length; then the HTTP header is taken off, the chunks
are joined, and the digest of the payload is compared with the header's.  Records that fail have ``problem`` set.

Defined cases: a null html is an empty payload; page_ids that are null or repeated keep their rows, for record
identifiers carry a row number where they need one; rows that repeat both the largest page_id and its payload are
all responses; bytes that are no UTF-8 are kept as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, has_columns, shared_folder, slices, table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
LEAST = 1000
#: Bytes of a block beyond which a record is segmented, and of a chunk.
SEGMENT = 16 << 10
CHUNK = 4 << 10
#: Records of a file at most.
RECORDS = 16384


def described(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to and ``named``: whether the record's identifier can do without a row number.

    One scan finds the payloads that several pages share, a second one meets them by digest; nothing ties a row of
    one scan to a row of the other, for splits may change when executors go.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    meta = pages.select("page_id", F.octet_length(payload).alias("bytes"), F.sha1(payload).alias("digest")).filter(F.col("bytes") >= least)
    per = meta.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    shared = per.groupBy("digest").agg(F.sum("n").alias("all"), F.max(F.struct("page_id", "n")).alias("top")).filter("all > 1")
    shared = cut(shared.select("digest", F.col("top.page_id").alias("to"), (F.col("top.n") == 1).alias("one")))
    own = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"))
    joined = own.join(shared.hint("merge"), own["payload_digest"] == shared["digest"], "left")
    revisit = ~F.col("to").eqNullSafe(F.col("page_id")) & F.col("digest").isNotNull()
    return joined.select("page_id", "url", "html", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("to")).alias("refers_to"), F.coalesce(F.col("one") & ~revisit, F.lit(False)).alias("named"))


def record_id(page_id: int | None, digest: str, row: int | None = None) -> str:
    """The identifier of the record of a page; with a row number where page and payload do not make it unique."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{'' if row is None else f':{row}'}>"


def page_of(identifier: str) -> int | None:
    found = identifier.strip("<>").split(":")[2]
    return int(found) if found else None


def pieces(data: bytes, most: int) -> Iterator[bytes]:
    """Cuts of at most ``most`` bytes that split no UTF-8 sequence, so archives of UTF-8 pages are texts."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        yield data[at:end]
        at = end


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(name: str, url: str, html: bytes, digest: str, refers: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's records, each with the blank line that ends it; ``refers``: the response's identifier of a revisit."""
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers is not None:
        extra = [("WARC-Refers-To", refers), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        # a revisit has the response's header alone, whose field tells the length of what it stands for
        yield record([("WARC-Type", "revisit"), *common, *extra, ("Content-Type", "application/http;msgtype=response")], f"HTTP/1.1 200 OK\r\nX-Payload-Length: {len(html)}\r\n\r\n".encode())
        return
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in pieces(html, CHUNK))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks + b"0\r\n\r\n"
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")], block)
        return
    parts = list(pieces(block, segment))
    for i, part in enumerate(parts, 1):
        if i == 1:
            yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), ("Content-Type", "application/http;msgtype=response")], part)
        else:
            last = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
            own = [("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
            yield record([("WARC-Type", "continuation"), *own, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i), *last], part)


def write_warc(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Writes the rows of ``pages`` (page_id, url, html) as gzipped WARC files under ``path``."""
    has_columns(pages, "page_id", "url", "html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    full = described(own, least).select("*", F.monotonically_increasing_id().alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = batch.column("html").cast(pa.binary()).to_pylist()
            others = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "revisit", "refers_to", "named", "row")), strict=True)
            out = []
            for html, (page, url, digest, revisit, to, named, row) in zip(texts, others, strict=True):
                name, refers = record_id(page, digest, None if named else row), record_id(to, digest) if revisit else None
                out += [r.removesuffix(b"\r\n\r\n") for r in records(name, url or "", html or b"", digest, refers, segment)]
            # the writer lays bytes out as they are, also those that are no UTF-8
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))], names=["value"])

    full.mapInArrow(work, "value string").write.option("maxRecordsPerFile", RECORDS).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file, gzipped or not."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue  # blank lines between records
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        yield headers, stream.read(int(headers["content-length"]))


SEGMENTS = "origin string, number int, type string, digest string, refers string, total long, uri string, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, as it stands in them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for h, block in parsed(batch.column("content")[i].as_py()):
                    total = h.get("warc-segment-total-length")
                    number = h.get("warc-segment-number")
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), int(number) if number else None, h["warc-type"], h.get("warc-payload-digest"), h.get("warc-refers-to"), int(total) if total else None, h.get("warc-target-uri"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(work, SEGMENTS)


def unchunked(body: bytes) -> bytes:
    """The content of a chunked message body; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than it says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return (unchunked(body) if headers.get(b"transfer-encoding") == b"chunked" else body), headers


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page record of the archives under ``path``, its segments put together."""
    rows = read_segments(spark, path)
    whole = rows.filter("number IS NULL").select("origin", "type", "digest", "refers", "uri", F.array("block").alias("blocks"), F.lit(None).cast("string").alias("problem"))
    # a group is one record's segments, so as large as that record
    cut_up = rows.filter("number IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "type", "digest", "refers", "uri", "total", "block"))).alias("s"))
    count, length = F.size("s"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    gapless = F.forall(F.transform("s", lambda x, i: x["number"] == i + 1), lambda x: x)
    problem = F.when(~gapless, "segments missing or repeated").when(last["total"].isNull() | (last["total"] != length), "total length differs").when(count < 2, "continuation missing")
    joined = cut_up.select("origin", first["type"].alias("type"), first["digest"].alias("digest"), first["refers"].alias("refers"), first["uri"].alias("uri"), F.col("s.block").alias("blocks"), problem.alias("problem"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, kind, digest, refers, uri, blocks, problem in zip(*(batch.column(c).to_pylist() for c in ("origin", "type", "digest", "refers", "uri", "blocks", "problem")), strict=True):
                told, data, size = (digest or "").removeprefix("sha1:"), None, None
                if problem is None:
                    try:
                        data, headers = payload_of(b"".join(blocks))
                        size = len(data)
                        if kind == "revisit":
                            data, size = None, int(headers[b"x-payload-length"])
                        elif hashlib.sha1(data).hexdigest() != told:
                            problem = "payload digest differs"
                    except (KeyError, ValueError) as e:
                        problem = f"broken message: {e}"
                out.append((page_of(origin), uri, data if payloads else None, size, told, kind, page_of(refers) if refers else None, problem))
            if out:
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return whole.unionByName(joined).mapInArrow(work, READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path, payloads=False)
    whole = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("WARC record: "), "problem"))).otherwise(F.col("payload_bytes"))
    return back.select("page_id", whole.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS b FROM pages),
d AS (SELECT page_id, b, sha1(h) AS d, max(page_id) OVER (PARTITION BY sha1(h), b) AS m FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM d
"""

QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {"op10_warc": ORACLE}

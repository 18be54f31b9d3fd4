"""WARC writing and reading with segmented records (WARC/1.1).

Writing: each row becomes a ``response`` record with an HTTP message in chunked
transfer coding, or a ``revisit`` record that refers to the response with the same
payload. A response block longer than ``SEGMENT_BYTES`` is cut: the first segment
is the response record (WARC-Segment-Number 1), the rest are ``continuation``
records that name it in WARC-Segment-Origin-ID; the last carries
WARC-Segment-Total-Length. Segments may end anywhere, within a chunk header or a
character too. Archives are gzip files written with Spark's text sink, one record a
row and CRLF between rows, so they land on any file system that Spark writes to.

Reading: archives are parsed by Content-Length only. Segments are grouped by
origin, ordered by segment number and verified: numbers run from one without a
gap, the total length is given and equals the joined length. Only then is the
HTTP message taken apart and its chunked body decoded and checked against
WARC-Payload-Digest. Records that fail keep their row, with ``error`` set and no
payload. Repeated copies of one segment count once if they are equal and are an
error if not.

Cases: a null payload counts as empty; a null url is written as an empty target.
A record is identified by its page_id, its payload's digest and its place among the
records of its task, so rows that share a page_id, or have none, keep their own
payloads. Rows that repeat a page_id with one payload all refer to the smallest page_id,
which is a response once per row with it; a revisit names that page_id and the
payload's digest, by which readers find any of them. Null ids never become a response that
others refer to unless no other id has the payload. Headers take values without
line breaks: these become spaces. An empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bitmap
from strandline.runtime import join_groups, shared_path, shared_table, ship

SEGMENT_BYTES = 4096
CHUNK_BYTES = 1500
#: Payload bytes of an archive, about; a longer record stands alone.
RECORDS_PER_FILE = 1000
#: Shorter payloads are always written as responses.
REVISIT_BYTES = 0

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """Body of a message in chunked coding; extensions and trailers are skipped. ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            break
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + size])
        at += size + 2
    if data[at : at + 2] != b"\r\n" and not data[at:].endswith(b"\r\n\r\n"):
        raise ValueError("no end of trailers")
    return b"".join(out)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def parse(data: bytes):
    """(headers in lower case, block) of every record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def record_id(*identity) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '#'.join(map(str, identity)))}>"


def records(row: str, url: str, payload: bytes, refers_to: str | None, date: str, segment: int, chunk: int, place: str = ""):
    """The WARC records of one row; ``refers_to`` is the row key of the response, None for a response itself.

    ``place`` tells rows apart that are equal in key and payload.
    """
    digest = payload_digest(payload)
    own_id = record_id(row, digest, place)
    common = [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Row", row)]
    if refers_to is not None:
        extra = [("WARC-Record-ID", own_id), ("WARC-Refers-To-Date", date), ("X-Refers-To-Row", refers_to), ("X-Payload-Length", str(len(payload)))]
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
        yield record("revisit", common + extra + profile, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    ids = [("WARC-Record-ID", own_id), ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        yield record("response", common + ids, block)
        return
    yield record("response", common + ids + [("WARC-Segment-Number", "1")], block[:segment])
    starts = range(segment, len(block), segment)
    for n, at in enumerate(starts, 2):
        own = [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", record_id(row, digest, place, n)), ("WARC-Segment-Origin-ID", own_id), ("WARC-Segment-Number", str(n))]
        if n == len(starts) + 1:
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", own, block[at : at + segment])


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, least: int = REVISIT_BYTES) -> None:
    """Archives below ``path`` for rows (page_id long, url string, payload binary).

    Which payloads repeat is found on digests alone; only rows whose digest may
    repeat (a bitmap of fixed size tells) are joined, the others go straight to
    their archive.
    """
    ship(pages.sparkSession)
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    narrow = shared_table(pages.filter(F.octet_length("payload") >= least).select(digest.alias("digest"), "page_id"), "warc-digests")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = shared_table(firsts, "warc-firsts")
    refers = join_groups(narrow, firsts, "digest", "n").filter("not (page_id <=> first)").select("page_id", "digest", "first").distinct()
    refers = shared_table(refers, "warc-refers")
    marked = bitmap.probe(pages.withColumn("digest", digest), bitmap.build(refers, "page_id", "digest"), "page_id", "digest")
    alone = marked.filter("not _may").withColumn("first", F.lit(None).cast("long"))
    again = marked.filter("_may").join(refers.withColumnRenamed("page_id", "_id"), F.col("page_id").eqNullSafe(F.col("_id")) & (marked.digest == refers.digest), "left").drop("_id").drop(refers.digest)
    todo = alone.select("page_id", "url", "payload", "first").union(again.select("page_id", "url", "payload", "first"))

    def run(batches):
        schema = pa.schema([("value", pa.binary())])
        task, number = TaskContext.get().partitionId(), 0
        for t in batches:
            out, held = [], 0
            for page, url, payload, first in zip(*(t.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                number += 1
                for r in records(str(page), url, payload, None if first is None else str(first), date, segment, chunk, f"{task}-{number}"):
                    out.append(r)
                    held += len(r)
                if held > 1 << 22:
                    yield pa.record_batch([pa.array(out, pa.binary())], schema=schema)
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], schema=schema)

    lines = todo.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PARTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("row", pa.string()), ("refers_row", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("block", pa.binary())])
_PARTS_SQL = "origin string, number int, total long, kind string, row string, refers_row string, digest string, length long, block binary"


def _parts(batches):
    for t in batches:
        for content in t.column("content"):
            rows, held = [], 0
            data = content.as_buffer().to_pybytes()
            for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                kind = h["warc-type"]
                if kind not in ("response", "revisit", "continuation", "resource"):
                    continue
                total, length = h.get("warc-segment-total-length"), h.get("x-payload-length")
                rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 0)), total and int(total), kind, h.get("x-row"), h.get("x-refers-to-row"), h.get("warc-payload-digest", "").removeprefix("sha1:"), length and int(length), block))
                held += len(block)
                if held > 1 << 22:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)


_WHOLE = pa.schema([("row", pa.string()), ("record_type", pa.string()), ("refers_row", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
_WHOLE_SQL = "row string, record_type string, refers_row string, payload_digest string, payload_bytes long, payload binary, error string"


def reassemble(parts: list[dict]) -> bytes:
    """The block of one record from its segments in any order. ValueError if they do not make one."""
    by_number: dict[int, dict] = {}
    for p in parts:
        other = by_number.setdefault(p["number"], p)
        if other["block"] != p["block"]:
            raise ValueError(f"two different segments {p['number']}")
    numbers = sorted(by_number)
    if numbers == [0]:
        return by_number[0]["block"]
    if numbers != list(range(1, len(numbers) + 1)):
        raise ValueError(f"segments {numbers}")
    block = b"".join(by_number[n]["block"] for n in numbers)
    total = by_number[numbers[-1]]["total"]
    if total is None or total != len(block):
        raise ValueError(f"{len(block)} bytes of {total}")
    return block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _whole(parts: list[dict]) -> list[tuple]:
    """One row per written copy of a record; copies only differ in number if rows repeat."""
    first = min(parts, key=lambda p: p["number"])
    copies = sum(p["number"] == first["number"] for p in parts)
    if first["kind"] == "revisit":
        return [(first["row"], "revisit", first["refers_row"], first["digest"], first["length"], None, None)] * copies
    try:
        payload = payload_of(reassemble(parts))
        digest = payload_digest(payload)
        error = None if first["digest"] in ("", digest) else f"digest {digest}"
    except (ValueError, KeyError) as e:
        payload, digest, error = None, first["digest"], str(e)
    return [(first["row"], first["kind"], None, digest, None if payload is None else len(payload), payload, error)] * copies


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_WHOLE)], schema=_WHOLE)


def read(spark, path: str) -> DataFrame:
    """Whole records of the archives below ``path``; only segmented ones are shuffled."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    parts = files.mapInArrow(_parts, _PARTS_SQL)

    def single(batches):
        for t in batches:
            for at in range(0, len(t), 200):
                yield from _table([r for p in t.slice(at, 200).to_pylist() for r in _whole([p])]).to_batches()

    def joined(t: pa.Table) -> pa.Table:
        return _table(_whole(t.to_pylist()))

    whole = parts.filter("number = 0").mapInArrow(single, _WHOLE_SQL)
    return whole.union(parts.filter("number > 0").groupBy("origin").applyInArrow(joined, _WHOLE_SQL))


def op8_warc_segments(spark, sf_dir: str) -> DataFrame:
    """Write ``pages`` as segmented, chunked WARC archives, read them back, and describe every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    path = shared_path(spark, "warc")
    write(pages, path)
    back = read(spark, path)
    return back.select(
        F.col("row").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_row").try_cast("long").alias("refers_to")
    )


OP8_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, strlen(html) AS n, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS digest
      FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

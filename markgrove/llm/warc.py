"""WARC archives: writing with segmentation, reading with segment reassembly.

write() gives each row a record: a response whose HTTP body is in chunked transfer framing, or a revisit of the response
with the same payload. A record whose block exceeds segment_bytes is cut into a first segment and continuation records.
Spark's text sink writes the archives, record by record and byte for byte, so any file system that Spark knows will do.
read() parses the archives; segments are grouped by origin identifier, ordered by segment number, their total length is
verified, and the chunked framing is decoded.

Defined results: a null payload is empty; a null identifier is written as an empty field and read back as null; of rows
with equal payloads and the least identifier all are responses (so repeated rows are too), and if that identifier is null
all are; a record whose segments, length, framing or digest do not fit gets a text in `problem` and keeps its header's
values; payloads are bytes, whatever they hold, of any length; an empty table writes no records and reads none; other columns,
whatever their names, are not carried. A record is held whole by one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Payloads under MIN_REVISIT bytes are always stored; blocks are cut at SEGMENT bytes; bodies are framed in CHUNK bytes.
MIN_REVISIT, SEGMENT, CHUNK = 100, 16 << 10, 4096

#: Bytes of one archive file before compression, about.
ARCHIVE = 32 << 20


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}{salt}'.encode()).digest())}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := body[i : i + size]), c) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = framed.index(b"\r\n", at)
        size = int(framed[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: dict[str, str | int], block: bytes) -> bytes:
    """One record without the last line end, which the sink adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b\r\n" % (VERSION, head.encode(), len(block), block)


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of one row: a revisit, a response, or the segments of a response."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    own = record_id(page_id, digest)
    fields: dict[str, str | int] = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": "" if page_id is None else page_id}
    if refers_to is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "Content-Type": "application/http; msgtype=response"}
        return [record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")]
    fields["Content-Type"] = "application/http; msgtype=response"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record(fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(fields | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more: dict[str, str | int] = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page_id, f"{digest}{n}"), "WARC-Date": DATE, "WARC-Target-URI": clean, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n}
        out.append(record(more | ({"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}), part))
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", segment_bytes: int = SEGMENT, min_revisit: int = MIN_REVISIT) -> None:
    """Write the rows' records as gzip-compressed archives into the folder at path."""
    tune(pages.sparkSession)
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(large.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    marked = marked.select("page_id", "url", "digest", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, url, digest, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += records_of(i, url, payload or b"", digest, first, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])

    # a reader holds an archive whole, so its size is bounded, whatever the size of a partition
    mean = rows.agg(F.avg(F.least(F.length("payload"), F.lit(segment_bytes)))).first()[0] or 0
    per_file = max(1, int(ARCHIVE / (mean + 600)))
    # the sink writes the bytes of a string as they are
    made = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive: header fields and block. Gzip members are unpacked; ValueError if the bytes are no archive."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:
            member = zlib.decompressobj(31)
            out.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = data.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in HEADER.findall(data[at : head + 2])}
        start = head + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length than it says")
        yield fields, data[start:end]
        at = end + 4


def payload_of(block: bytes) -> bytes:
    """The HTTP body of a response block, its framing undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


PARTS = "record_id string, page_id long, kind string, digest string, refers_to_id string, payload binary, origin string, segment int, total long, block binary, problem string"
WHOLE = "record_id string, page_id long, kind string, digest string, refers_to_id string, payload binary, problem string"


def finish(digest: str | None, block: bytes) -> tuple[bytes | None, str | None]:
    """Payload and problem of a whole response block."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, f"framing: {e}"
    return payload, None if digest == hashlib.sha256(payload).hexdigest() else "digest differs"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, reassembled: record_id, page_id, kind, digest, refers_to_id, payload, problem."""
    tune(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in PARTS.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for f, block in parse(content.as_py()):
                    segment, origin = int(f.get("warc-segment-number", 0)), f.get("warc-segment-origin-id")
                    page, digest = f.get("x-page-id"), (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None
                    payload, problem = finish(digest, block) if f["warc-type"] == "response" and not segment else (None, None)
                    rows.append((f["warc-record-id"], int(page) if page else None, f["warc-type"], digest, f.get("warc-refers-to"), payload, (origin or f["warc-record-id"]) if segment else None, segment or None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block if segment else None, problem))
                    size += len(block)
                    if size > 8 << 20:
                        yield pack(rows)
                        rows, size = [], 0
        if rows:
            yield pack(rows)

    parts = files.mapInArrow(scan, PARTS)
    segment = F.struct("segment", "record_id", "page_id", "digest", "total", "block", "kind")
    # a segment that was written more than once (a repeated row) counts once
    sets = parts.where("segment is not null").groupBy("origin").agg(F.array_sort(F.collect_set(segment)).alias("segments"), F.count(F.when(F.col("segment") == 1, 1)).alias("n"))
    sets = sets.select("origin", "segments", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)).cast("int"))).alias("copy")).drop("copy")

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(s["block"] for s in segments)
                first, total = segments[0], segments[-1]["total"]
                payload, problem = (None, None)
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                    problem = "segments missing"
                elif total != len(block):
                    problem = "total length differs"
                else:
                    payload, problem = finish(first["digest"], block)
                out.append((origin, first["page_id"], first["kind"], first["digest"], None, payload, problem))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in WHOLE.split(", ")])

    whole = parts.where("segment is null").select(*[x.split()[0] for x in WHOLE.split(", ")])
    return whole.unionByName(sets.mapInArrow(join_segments, WHOLE))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write(pages, path)
    payload = F.col("payload")
    back = read(pages.sparkSession, path).select("record_id", "page_id", "kind", "refers_to_id", "digest", "problem", F.sha2(payload, 256).alias("own_digest"), F.length(payload).cast("long").alias("bytes"))
    back = scratch.table(back, "records")
    scratch.remove(path)
    targets = back.where("kind = 'response'").groupBy("record_id").agg(F.min("page_id").alias("to_page"), F.max("bytes").alias("to_bytes"), F.max("own_digest").alias("to_digest"))
    # only revisits are joined: the null reference of all other records would be one key
    revisits = back.where("kind = 'revisit'").join(targets.withColumnRenamed("record_id", "to_id"), F.col("refers_to_id") == F.col("to_id"), "left")
    revisits = revisits.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("to_page").alias("refers_to"), "problem")
    own = back.where("kind != 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return own.unionByName(revisits)


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, NULL::VARCHAR AS problem
FROM g
"""

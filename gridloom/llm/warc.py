"""WARC archives: written with segments and revisits, read back with reassembly.

Records are written by Spark's own writer, one gzip member each, so any store
that Spark writes to will do. Long records are cut into segments; reading
groups continuation records by their origin, orders them by number, verifies
the total length and undoes the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bloom_bits, bloom_build, bloom_test
from gridloom.session import scratch_root

#: Bytes of a record's block from which on it is cut, of a chunk of the transfer framing, and records per file.
SEGMENT, CHUNK, PER_FILE = 256 << 10, 16 << 10, 2000
#: Smaller payloads are never revisits.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
#: Salts of the look-up of payloads that several pages share.
SALTS = 32


def chunked(payload: bytes) -> bytes:
    """Transfer framing: chunks with their length in hex, closed by an empty one."""
    out = []
    for i in range(0, len(payload), CHUNK):
        part = payload[i: i + CHUNK]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        size = body[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n: at + n + 2] != b"\r\n":
            return None
        out.append(body[at: at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The gzipped records of one page: a revisit of ``first``, or a response with its continuations."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}:{digest}>"
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        common.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = [("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id)), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(first)), *kind]
        yield _record(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i: i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        numbered = [("WARC-Segment-Number", str(n))] if len(parts) > 1 else []
        if n == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name(page_id)), *common, *kind, *numbered], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", name(page_id)), ("WARC-Date", DATE), *numbered, *last], part)


def _with_first(pages: DataFrame) -> DataFrame:
    """Adds ``first``: the smallest page with the same payload, for all others that have it; else null.

    Payloads that one page alone has never leave their partition: a Bloom
    filter tells them apart. The others are looked up in salted parts, since
    one payload may hold many rows.
    """
    large = pages.filter(F.col("payload_bytes") >= LEAST)
    many = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    n = many.count()
    if not n:
        return pages.withColumn("first", F.lit(None).cast("long"))
    bits, hashes = bloom_bits(n, 0.001)
    key = F.xxhash64("payload_digest")
    data = bloom_build(many, key, bits, hashes)
    shared = (F.col("payload_bytes") >= LEAST) & bloom_test(key, data, bits, hashes)
    salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = pages.filter(shared).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["payload_digest", "salt"], "left").drop("salt")
    found = found.withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    return pages.filter(~shared).withColumn("first", F.lit(None).cast("long")).unionByName(found)


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT) -> str:
    """Writes one record per row, continuations apart, and returns the folder, in the shared scratch space.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads
    of at least LEAST bytes those with the smallest page_id are responses, the
    others revisit it; a null id is never the smallest, and all are responses
    when no row of the payload has an id. Other columns are not read; an empty
    table gives an empty folder.
    """
    spark = pages.sparkSession
    df = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload_of(F.col(html)).alias("payload"))
    df = _with_first(df.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "first")]
            out, size = [], 0
            for i in range(batch.num_rows):
                for r in records(*(c[i].as_py() for c in columns), segment):
                    # A member ends with its plain length, 4 bytes from low to high. Segments are short, so the last is 0: the writer adds it.
                    out.append(r[:-1])
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    path = f"{scratch_root(spark).rstrip('/')}/gridloom/llm-warc-{uuid.uuid4().hex}"
    rows = df.select("page_id", "url", "payload", "payload_digest", "first").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", PER_FILE).text(path)
    return path


# ------------------------------------------------------------------ reading

def members(data: memoryview) -> Iterator[bytes]:
    """Plain content of an archive, member by member if it is gzipped."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    at = 0
    while at < len(data):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof and at < len(data):
            part = data[at: at + (64 << 10)]
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield b"".join(out)


def parse(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record; what follows a broken record in its member is skipped."""
    for content in members(data):
        at = 0
        while (head := content.find(b"WARC/", at)) >= 0:
            end = content.find(b"\r\n\r\n", head)
            if end < 0:
                break
            lines = content[head:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = fields.get("content-length", "")
            if not size.isdigit() or end + 4 + int(size) > len(content):
                break
            at = end + 4 + int(size)
            yield fields, content[end + 4: at]


def http_payload(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload and announced length of an http response; no payload if its framing is broken."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None, None
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block[:end].split(b"\r\n")[1:])}
    body = block[end + 4:]
    size = head.get(b"content-length", b"")
    if head.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
    return body, int(size) if size.isdigit() else None


_SEGMENTS = "record_id string, record_type string, refers_to string, digest string, number long, total long, announced long, block binary"


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "refers_to", "digest", "number", "total", "announced", "block"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.binary()]
    number = lambda v: int(v) if v is not None and v.isdigit() else None
    for batch in it:
        for content in batch.column("content"):
            rows, size = [], 0
            for f, block in parse(memoryview(content.as_buffer())):
                kind = f.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                n, announced = number(f.get("warc-segment-number")), None
                if n is None:  # whole: its framing can be undone here
                    block, announced = http_payload(block)
                name = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
                rows.append((name, kind, f.get("warc-refers-to"), f.get("warc-payload-digest"), n, number(f.get("warc-segment-total-length")), announced, block))
                size += len(block or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ordered segments of each record and undoes its framing; what is not complete has no payload."""
    for batch in it:
        for i in range(batch.num_rows):
            parts, total = batch.column("parts")[i].as_py(), batch.column("total")[i].as_py()
            block = b"".join(p["block"] for p in parts)
            right = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == total
            payload = http_payload(block)[0] if right else None
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("record_id", "digest", "copies")), pa.array([payload], pa.binary())], ["record_id", "digest", "copies", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives of a folder: record_id, record_type, refers_to, digest, announced, payload.

    Continuations are put together with their origin: equal segments that came
    twice under one identifier are kept once and counted, and the record is
    returned as often as its first segment was found. ``payload`` is null where
    a segment is missing or contradicts another, the total length is wrong, or
    the framing is broken, and empty for revisits. ``digest`` is as announced.
    An archive is read whole by one task: keep files well below 2 GB. Any other
    record type is skipped; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")
    found = files.mapInArrow(_segments, _SEGMENTS)
    whole = found.filter("number is null and record_type <> 'continuation'").select("record_id", "record_type", "refers_to", "digest", "announced", F.col("block").alias("payload"))
    parts = found.filter("number is not null").groupBy("record_id", "number", "block").agg(
        F.count("*").alias("copies"), F.max("total").alias("total"), F.max("digest").alias("digest"))
    records_ = parts.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("digest").alias("digest"),
        F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"))
    put = records_.filter("copies is not null").mapInArrow(_whole, "record_id string, digest string, copies long, payload binary")
    put = put.select("record_id", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "digest", F.lit(None).cast("long").alias("announced"), "payload", "copies")
    put = put.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    return whole.unionByName(put)


def page_records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that ``write_archives`` made."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return archives.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("announced")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(revisit, page(F.col("refers_to"))).alias("refers_to"),
    )

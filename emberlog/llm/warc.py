"""WARC archives compressed record by record with a dictionary of their own.

An archive is a leading skippable frame that holds a Zstandard dictionary, then one frame
a record.  The dictionary is built from the first records of the archive.  Archives are
rows of a table (archive, content) in a shared folder; ``export`` writes them as files
where a folder is mounted, ``scan_files`` reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Magic numbers of the formats: a skippable frame for dictionaries, and any data frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: A new archive begins when so many bytes of records are held.
ARCHIVE_BYTES = 16 << 20
#: A dictionary is built from so many bytes of records at most, and has so many.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
LEVEL = 3
#: Bytes of an archive that are handed to the decoder at once.
WINDOW = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A record's name: a UUID with the page's id in its lower half."""
    return f"<urn:uuid:{uuid.UUID(int=(0x5741 << 112) | (1 << 64 if page_id is None else page_id & (1 << 64) - 1))}>"


def page_of(name: str) -> int | None:
    n = uuid.UUID(name[10:-1]).int
    if n >> 64 & 1:
        return None
    low = n & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header of the payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records; of too few or too uniform ones, the end of them as they are."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: SAMPLE_BYTES - size])
        size += len(r)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def archive(records: list[bytes]) -> bytes:
    """The leading dictionary frame (the dictionary itself compressed) and a frame a record."""
    raw = dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed + b"".join(map(coder.compress, records))


def records(content: bytes):
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", content)
    at, raw = 0, None
    if magic == DICTIONARY_MAGIC:
        held = content[8 : 8 + size]
        raw = zstandard.ZstdDecompressor().decompress(held) if held[:4] == struct.pack("<I", FRAME_MAGIC) else held
        at = 8 + size
    view = memoryview(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw is not None else zstandard.ZstdDecompressor()
    while at < len(content):
        frame, data = reader.decompressobj(), []
        while not frame.eof and at < len(content):
            data.append(frame.decompress(view[at : at + WINDOW]))
            at += min(WINDOW, len(content) - at)
        at -= len(frame.unused_data)
        yield b"".join(data)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header fields (names in lower case), HTTP header, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html) with refers_to and revisit.

    Of records with equal payloads of at least ``least`` bytes that with the largest
    page_id is the response.  Only digests are shuffled for that, and equal ones are
    reduced before.
    """
    same = F.sha2(F.coalesce("html", F.lit("")), 256)
    slim = pages.select("page_id", same.alias("same"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).filter(F.col("size") >= least)
    last = slim.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to").drop("low")
    revisits = slim.join(last, "same").filter("page_id < refers_to").select("page_id", "same", "refers_to").distinct()
    return pages.withColumn("same", same).join(revisits, ["page_id", "same"], "left").withColumn("revisit", F.col("refers_to").isNotNull())


def write(scratch: Scratch, pages: DataFrame, name: str = "archives", least: int = 0) -> DataFrame:
    """Write a record for every page; returns the table of archives (archive, content).

    ``pages`` has page_id, url and html; a null html is an empty payload.  Rows that repeat
    a page_id are each written, of equal payload as the same kind; a page without an id is
    always a response.
    """

    def pack(batches):
        held, size = [], 0

        def done():
            content = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:32]]), pa.array([content], pa.large_binary())], names=["archive", "content"])

        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    rows = plan(pages.select("page_id", "url", "html"), least).select("page_id", "url", "html", "refers_to", "revisit")
    packed = rows.mapInArrow(lambda b: (pa.RecordBatch.from_arrays([x.column(0), x.column(1).cast(pa.binary())], names=x.schema.names) for x in pack(b)), "archive string, content binary")
    return scratch.save(packed, name)


def read(archives: DataFrame, content: str = "content") -> DataFrame:
    """Every record of a table of archives.

    Returns page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes and payload_digest, both of the full payload.  A payload that does not
    have the digest of its header stops the job.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def unpack(batches):
        for batch in batches:
            for held in batch.column(0):
                rows, size = [], 0
                for data in records(held.as_py()):
                    fields, http, payload = parse(data)
                    kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != named:
                        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, payload if kind == "response" else None, full, named))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    return archives.select(content).mapInArrow(unpack, schema)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc.zst`` files under a path that Spark can read."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of a folder that all executors have mounted."""

    def put(rows):
        for r in rows:
            with open(f"{folder}/{r.archive}.warc.zst", "wb") as f:
                f.write(r.content)

    archives.foreachPartition(put)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    return read(write(Scratch(spark, "warc"), pages, least=least))

"""WARC archives without repeated payloads.

Headers alone are dealt out by payload digest and give each digest's original response; every record then learns
whether it is that response or revisits it, and is written with fresh headers. A record is a gzip member of its
own. Reading gives headers back, and a revisit gets its payload's size from the response that it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, file_system, join_hot, replace

#: payloads of fewer bytes are always written in full
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: compressed bytes after which a task begins a new file
FILE_BYTES = 256 << 20
LEVEL = 3


def payload_headers(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of every page; a null payload is an empty one."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )


def originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, response, n) of digests that several records have; the largest page_id is the response.

    Where headers have a column has_payload, the response is the largest page_id among the records with a payload, as
    revisits that were read from an archive have none; digests without such a record have no response.
    """
    large = headers.filter(F.col("payload_bytes") >= least)
    able = F.when(F.col("has_payload"), F.col("page_id")) if "has_payload" in headers.columns else F.col("page_id")
    return large.groupBy("payload_digest").agg(F.max(able).alias("response"), F.count("*").alias("n")).filter(
        "n > 1 and response is not null"
    )


def resolve_revisits(records: DataFrame, headers: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """records (with page_id, payload_bytes, payload_digest) and refers_to: the response's page_id, null for responses.

    Rows of one page_id and payload are the same record, so all of them are the response or none. Digests with a
    thousandth of all records or more are at most a thousand and broadcast; the others meet by digest.
    """
    found = scratch.keep(originals(headers, least), "originals")
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(100, total // 1000)
    joined = join_hot(
        records.withColumn("_key", F.when(F.col("payload_bytes") >= least, F.col("payload_digest"))),
        found.withColumnRenamed("payload_digest", "_key"),
        "_key",
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        hot,
    )
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("response"))).drop("response", "n", "_key")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def make_record(page: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archive:
    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.bytes = self.records = 0

    def add(self, record: bytes) -> None:
        data = gzip_member(record)
        self.out.write(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        replace(self.fs, self.part, self.path)
        return self.uri, self.records, self.bytes


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, payload_digest, html, refers_to); a row (file, records, bytes) for every file.

    Files are named by partition and number; a task that runs again replaces its files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, done = TaskContext.get().partitionId(), None, []
        for b in batches:
            for page, url, digest, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or _Archive(f"{folder}/{part:06d}-{len(done):04d}.warc.gz")
                out.add(make_record(page, url, digest, (html or "").encode(), refers_to))
                if out.bytes >= FILE_BYTES:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"]
        )

    return records.select("page_id", "url", "payload_digest", "html", "refers_to").mapInArrow(
        write, "file string, records long, bytes long"
    )


def members(uri: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, each unpacked by itself."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z, parts = zlib.decompressobj(31), []
        while data := f.read(step):
            while data:
                parts.append(z.decompress(data))
                data = z.unused_data
                if z.eof:
                    yield b"".join(parts)
                    z, parts = zlib.decompressobj(31), []


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


READ = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_record string, refers_to long, html string"


def read_archives(spark: SparkSession, files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files (a column ``file``), with payloads if asked; digests of responses are made anew."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in READ.split(", ")), strict=True)
        types = [pa.int64() if k == "long" else pa.string() for k in kinds]
        for b in batches:
            for file in b.column(0).to_pylist():
                rows, held = [], 0
                for record in members(file):
                    f, block = parse_record(record)
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = f["warc-type"] == "response"
                    digest = (
                        hashlib.sha1(payload)
                        .hexdigest() if full else base64.b32decode(f["warc-payload-digest"].partition(":")[2])
                        .hex()
                    )
                    page, to = f.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append(
                        (
                            f["warc-record-id"],
                            f["warc-type"],
                            page and int(page),
                            f["warc-target-uri"],
                            digest,
                            len(payload) if full else None,
                            f.get("warc-refers-to"),
                            to and int(to),
                            payload.decode() if payloads and full else None,
                        )
                    )
                    held += len(payload) if payloads else 300
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))

    return files.select("file").mapInArrow(read, READ)


def deduplicated_archives(
    pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES
) -> DataFrame:
    """Write pages as archives without repeated payloads; the files written."""
    headers = payload_headers(pages, page_id, html)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    records = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.col(html).alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )
    return scratch.keep(write_archives(resolve_revisits(records, headers, scratch, least), scratch.path("archives")), "files")


def with_payload_bytes(records: DataFrame) -> DataFrame:
    """Records read, where a revisit has the payload size of the response it refers to; a row a record."""
    sizes = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("to")).agg(
        F.max("payload_bytes").alias("bytes"), F.lit(1).alias("n")
    )
    known = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes")
    counts = revisits.groupBy(F.col("refers_to_record").alias("to")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    wanted = sizes.drop("n").join(counts, "to").withColumnRenamed("to", "refers_to_record").withColumnRenamed("bytes", "payload_bytes")
    joined = join_hot(revisits, wanted, "refers_to_record", F.col("record_id"), F.col("n") >= max(100, total // 1000)).drop("n")
    return known.unionByName(joined)


def rewritten_archives(records: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """Write records read from archives (``read_archives`` with payloads), revisits among them, as archives without
    repeated payloads and with fresh headers; the files written.

    A revisit is joined to the response that it refers to. Of records with one large payload the response is one that
    brings the payload, whatever the others' ids; a small revisit gets its payload back. A revisit whose response is
    in none of the archives stays one.
    """
    # a response without a page_id could be referred to by nobody
    full = with_payload_bytes(records).withColumns(
        {"has_payload": (F.col("record_type") == "response") & F.col("page_id").isNotNull(), "_told": F.col("refers_to")}
    )
    small = (
        full.filter(F.col("has_payload") & (F.col("payload_bytes") < least))
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("html").alias("_html"))
    )
    lacks = (F.col("record_type") == "revisit") & (F.col("payload_bytes") < least)
    full = (
        full.join(small, lacks & (F.col("payload_digest") == F.col("_digest")), "left")
        .withColumn("html", F.coalesce("html", "_html"))
        .drop("refers_to", "_html", "_digest")
    )
    headers = full.select("page_id", "payload_bytes", "payload_digest", "has_payload")
    found = resolve_revisits(full, headers, scratch, least)
    alone = (F.col("record_type") == "revisit") & F.col("refers_to").isNull() & ~(F.col("payload_bytes") < least).eqNullSafe(F.lit(True))
    found = found.withColumn("refers_to", F.when(alone, F.coalesce("_told", "page_id")).otherwise(F.col("refers_to")))
    return scratch.keep(write_archives(found, scratch.path("archives")), "files")

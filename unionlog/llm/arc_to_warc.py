"""Converts legacy ARC archives into WARC, with duplicates as revisits, and reads WARC back.

An ARC file begins with a version block whose first body line names the version and whose second line
names the fields of a record's header line; the last field is the declared length of the record's body.
Version 1 has five fields, version 2 ten. The converter parses header lines by the version block of
the file it reads, takes exactly the declared bytes, and synthesises for each record what WARC needs
and ARC lacks: an identifier derived from the record itself (so a repeated task writes the same one), an
ISO timestamp from the 14-digit date, a record type, and SHA-256 digests of block and payload.

The query writes `pages` as ARC in memory, file after file, alternating versions, converts each to a gzipped
WARC file (a member a record) in the shared folder, and reads these files back. Which record a revisit
refers to is settled before, by a join on the payload's digest: only digests that repeat are in its
small side, and adaptive execution splits a digest that holds many rows.

Nulls: a null html is an empty payload, a null url becomes 'urn:none', a null page_id stays null (never
chosen as the original unless all are null, in which case the record is a response). Repeated rows are records
of their own: equal page_ids of equal payload are all the response's page, so each is a response.
An empty table gives no rows. Files of failed attempts are listed nowhere and so are never read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm.common import cut, shared_dir, table, trimmed

#: Payloads below this are always written in full.
MIN_REVISIT_BYTES = 100
#: A WARC file is closed once it holds as many bytes before compression; it is built in memory.
FILE_BYTES = 16 << 20
GZIP_LEVEL = 4
#: Compressed bytes given to a record's decompressor at a time.
PIECE = 1 << 13

# Fixed values of the ARC format: header fields by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_DATE = "20240101000000"
CRLF = b"\r\n"


class ArcError(ValueError):
    """The bytes are not an ARC file of a known version."""


def arc_header(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 unionlog\n{' '.join(ARC_FIELDS[version])}\n".encode()
    # The version block itself always has a version-1 header line in files of either version.
    return arc_header(1, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": "text/plain", "Archive-length": str(len(body))}) + body + b"\n"


def arc_record(version: int, url: str, content_type: str, body: bytes, status: int = 200) -> bytes:
    values = {"URL": url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09"), "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": content_type, "Result-code": str(status), "Archive-length": str(len(body))}
    return arc_header(version, values) + body + b"\n"


def http_message(page_id: int | None, payload: bytes) -> bytes:
    ident = "-" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {ident}\r\n\r\n".encode() + payload


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) for each record after the version block."""
    at, fields = 0, ARC_FIELDS[1]
    first = True
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line that ends a record
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError("header line does not end")
        values = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ArcError(f"header line has {len(values)} fields; the version has {len(fields)}")
        head, size = dict(zip(fields, values, strict=True)), int(values[-1])
        body = bytes(view[end + 1 : end + 1 + size])
        if len(body) != size:
            raise ArcError("record is shorter than its declared length")
        at = end + 1 + size
        if first:
            if not head["URL"].startswith("filedesc:"):
                raise ArcError("no version block")
            lines = body.decode().splitlines()
            version = int(lines[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ArcError(f"version {version}")
            fields = lines[1].split(" ") if len(lines) > 1 else ARC_FIELDS[version]
            first = False
        else:
            yield head, body


def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, digest, key)))}>"


def _http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, sep, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head + sep, fields, payload


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + CRLF + CRLF


def to_warc(head: dict[str, str], body: bytes, refers_to: str | None = None) -> bytes:
    """The WARC record for an ARC record; a revisit if refers_to names the page that has its payload."""
    url, date, kind = head["URL"], iso_date(head["Archive-date"]), head["Content-type"]
    is_http = body.startswith(b"HTTP/")
    http, http_fields, payload = _http_parts(body) if is_http else (b"", {}, body)
    digest = hashlib.sha256(payload).hexdigest()
    fields = {"WARC-Type": "response" if is_http else "resource", "WARC-Record-ID": record_id(url, date, digest, http_fields.get("X-Page-Id", "")), "WARC-Date": date, "WARC-Target-URI": url}
    fields["Content-Type"] = "application/http;msgtype=response" if is_http else kind
    block = body
    if refers_to is not None:
        block = http
        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-Id": refers_to}
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file of gzip members, fed piece by piece."""
    at = 0
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("a record does not end")
            piece = data[at : at + PIECE]
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, tail[: int(fields["Content-Length"])]


def _write_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        arc, refs, version = io.BytesIO(), [], 1

        def close() -> pa.RecordBatch:
            name, warc = uuid.uuid4().hex, io.BytesIO()
            # Legacy bytes in, parsed by version and declared lengths, WARC out.
            for (head, body), ref in zip(parse_arc(arc_version_block(version, f"{name}.arc") + arc.getvalue()), refs, strict=True):
                z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                warc.write(z.compress(to_warc(head, body, ref)) + z.flush())
            with fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out:
                out.write(warc.getbuffer())
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}.warc.gz"], "records": [len(refs)]})

        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                arc.write(arc_record(version, url, "text/html", http_message(page_id, payload)))
                refs.append(None if refers_to is None else str(refers_to))
                if arc.tell() >= FILE_BYTES:
                    yield close()
                    arc, refs, version = io.BytesIO(), [], 3 - version
        if refs:
            yield close()

    return run


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for file in batch.column(0).to_pylist():
            fs, path = FileSystem.from_uri(file)
            with fs.open_input_file(path) as f:
                data = f.read()
            rows = []
            for fields, block in read_warc(data):
                _, http, payload = _http_parts(block)
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{file}: payload and digest differ")
                page, ref = http["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                rows.append((None if page == "-" else int(page), int(http["Content-Length"]), digest, kind, None if ref is None else int(ref)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(file, records) of the WARC files written for pages (page_id, url, html)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("urn:none")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= MIN_REVISIT_BYTES
    shared = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Written, so that the join below deals both of its sides itself and can split a hot digest.
    marked = rows.join(cut(shared), "digest", "left").drop("digest")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return cut(marked.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(trimmed(_write_files(folder)), "file string, records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    files = manifest.select("file").repartition(max(1, 2 * manifest.sparkSession.sparkContext.defaultParallelism))
    return files.mapInArrow(trimmed(_read_files), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_dir(spark)))


QUERIES = {"op4_arc_to_warc": op4_arc_to_warc}
ORACLES = {
    "op4_arc_to_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
}

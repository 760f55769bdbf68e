"""WARC archives: writing, normalising monolithic gzip files to one member for each record, reading by a sidecar index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, table, written

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: There is no time of fetching in the table.
DATE = "1970-01-01T00:00:00Z"

ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "path string, index string, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}/{digest}')}>"


_CONTROLS = re.compile(r"[\x00-\x1f\x7f]")
#: Own header that says that a URL's controls and per cent signs are per cent encoded; URLs without controls are written as they are.
ESCAPED = "X-Target-URI-Escaped"


def _line(value: str) -> str:
    """A header's value whose controls would end the line: these and % per cent encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unline(value: str) -> str:
    return re.sub(r"%(0[0-9A-F]|1[0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response, or a revisit: its HTTP header without the payload, whose length and digest the headers keep."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head += [("WARC-Target-URI", _line(url)), (ESCAPED, "yes")] if _CONTROLS.search(url) else [("WARC-Target-URI", url)]
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    block = http if revisit else http + payload
    head.append(("Content-Length", len(block)))
    return VERSION + CRLF + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> dict:
    """A whole record; a response's payload must have the length and digest that its headers state."""
    head, _, block = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    stated = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != stated or digest32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its headers")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-ID"), "url": _unline(url) if ESCAPED in fields else url, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload_digest": digest, "payload_bytes": stated, "payload": payload if kind == "response" else None}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from inflated bytes in any portions; holds one record and one portion."""
    data = bytearray()
    need = None
    for chunk in chunks:
        data += chunk
        while True:
            if need is None:
                if (end := data.find(CRLF + CRLF)) < 0:
                    break
                length = re.search(rb"\r\nContent-Length: (\d+)(?=\r\n|$)", bytes(data[:end]))
                if length is None:
                    raise ValueError("a record states no length")
                need = end + 4 + int(length[1]) + 4
            if len(data) < need:
                break
            yield bytes(data[:need])
            del data[:need]
            need = None
    if data:
        raise ValueError("the archive ends within a record")


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in portions of bounded size. A member without its end is an error."""
    pump, inside = zlib.decompressobj(31), False
    while chunk := source.read(READ_BYTES):
        while chunk:
            yield pump.decompress(chunk, 4 * READ_BYTES)
            inside = not pump.eof
            chunk = pump.unconsumed_tail or pump.unused_data
            if pump.eof:
                pump = zlib.decompressobj(31)
    if inside:
        raise ValueError("the gzip stream is cut off")


def write_monolithic(pages: DataFrame, out: str, level: int = 1, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to, revisit) as gzip files that are each one stream; returns the manifest.

    A try of a task writes under names of its own; the manifest lists those of the try that counted."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = fs.FileSystem.from_uri(out)
        done, sink, path, n, size = [], None, None, 0, 0

        def close():
            sink.write(squeeze.flush())
            sink.close()
            done.append((path, None, n))

        for pdf in batches:
            for page, url, html, refers, again in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["revisit"], strict=True):
                if sink is None:
                    where.create_dir(base, recursive=True)
                    name = f"mono-{uuid.uuid4().hex}.warc.gz"
                    path, n, size, squeeze = f"{out}/{name}", 0, 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                    sink = where.open_output_stream(f"{base}/{name}", compression=None)
                data = record(None if pd.isna(page) else int(page), url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(refers) else int(refers), bool(again))
                sink.write(squeeze.compress(data))
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "index", "records"])

    return written(pages.mapInPandas(write, MANIFEST), "warc-manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """A task for each file."""
    return manifest.coalesce(1).repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, out: str, level: int = 6) -> DataFrame:
    """Inflates each file once, as a stream, and rewrites every record as a gzip member of its own; a sidecar index lists
    offset, length and record id of each, one a line. Returns the new manifest. A file that is cut off, or whose records aren't as
    many as the manifest states, raises an error."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for path, records in zip(pdf["path"], pdf["records"], strict=True):
                where, base = fs.FileSystem.from_uri(out)
                where.create_dir(base, recursive=True)
                name = uuid.uuid4().hex
                source_fs, source_path = fs.FileSystem.from_uri(path)
                offset = n = 0
                with source_fs.open_input_stream(source_path, compression=None) as source, where.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as sink, where.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for data in split_records(inflate(source)):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(data) + squeeze.flush()
                        sink.write(member)
                        index.write(f"{offset} {len(member)} {re.search(rb'WARC-Record-ID: ([^\r]*)', data)[1].decode()}\n".encode())
                        offset, n = offset + len(member), n + 1
                if n != records:
                    raise ValueError(f"{path} holds {n} records instead of {records}")
                done.append((f"{out}/{name}.warc.gz", f"{out}/{name}.idx", n))
            yield pd.DataFrame(done, columns=["path", "index", "records"])

    return written(_dealt(manifest).mapInPandas(rewrite, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of normalised archives (RECORDS), each member found by the index and inflated on its own. Archives that
    give fewer or more records than the manifest states raise an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for pdf in batches:
            for path, index, records in zip(pdf["path"], pdf["index"], pdf["records"], strict=True):
                where, at = fs.FileSystem.from_uri(path)
                rows, size, seen = [], 0, 0
                with where.open_input_stream(fs.FileSystem.from_uri(index)[1], compression=None) as lines, where.open_input_file(at) as source:
                    rest = b""
                    while True:
                        chunk = lines.read(READ_BYTES)
                        *whole, rest = (rest + chunk).split(b"\n")
                        for line in whole:
                            offset, length, _ = line.split(b" ", 2)
                            row = parse(zlib.decompress(source.read_at(int(length), int(offset)), 31))
                            if not payloads:
                                row["payload"] = None
                            rows.append(row)
                            seen += 1
                            size += 200 + len(row["payload"] or b"")
                            if size > BATCH_BYTES:
                                yield frame(rows)
                                rows, size = [], 0
                        if not chunk:
                            break
                if seen != records:
                    raise ValueError(f"{path} holds {seen} records instead of {records}")
                yield frame(rows)

    return _dealt(manifest).mapInPandas(read, RECORDS)


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> page_id, url, html, refers_to, revisit: of pages with equal payloads of at least least_bytes bytes that with the
    smallest id is the response; the others are revisits of it. Digests and ids alone are shuffled."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).alias("n"))
    shared = rows.filter(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    rows = rows.join(written(shared, "warc-shared"), ["sha", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))


def archive(pages: DataFrame, out: str, least_bytes: int = 0, level: int = 6, roll_bytes: int = ROLL_BYTES, **cols) -> DataFrame:
    """Writes pages as WARC files below out and returns the manifest of the normalised ones.

    A null html is an empty payload, a null url or page_id leaves its header out. Rows that repeat both page_id and payload are
    all responses when theirs is the smallest id. A null page_id is never referred to unless no row of that payload
    has one; then all are responses. An empty table gives no files."""
    mono = write_monolithic(with_revisits(pages, least_bytes, **cols), f"{out}/mono", roll_bytes=roll_bytes)
    return normalise(mono, f"{out}/warc", level)


def op4(spark, sf_dir):
    found = read_archives(archive(table(spark, sf_dir, "pages"), scratch(spark, "warc")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives: a writer of one gzip member per record, and a sequential reader that verifies them.

Archives lie in a folder of any file system that Arrow knows. Each task writes its own files under names that
no other attempt uses and reports them when they are closed, so a lost executor leaves at most a file that
nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, as_strings, scratch, scratch_path

#: A new archive is begun after so many bytes.
ROLL = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry no time of their own in the table; a fixed date keeps archives reproducible.
DATE = "2000-01-01T00:00:00Z"
#: So many digests, of 32 bytes and an id each, are sent to all workers at most.
MOST_BROADCAST = 200_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def _safe(value: str) -> str:
    """Control characters would end a header line: they are percent-encoded, and so are percent signs that look like it."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[01][0-9A-F]|7F)", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or, if refers_to is given, a revisit that has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_safe(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def members(stream, chunk: int = 1 << 20, step: int = 1 << 14) -> Iterator[bytes]:
    """The content of each gzip member of a stream, inflated step by step; what doesn't end is an error."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    while data := stream.read(chunk):
        at = 0
        while at < len(data):  # small steps: what follows a member's end is copied
            part = data[at : at + step]
            begun = True
            parts.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    payload: bytes
    #: Of the full payload: a revisit's is that of the response it refers to.
    payload_length: int
    digest: str = field(default="")

    def page(self, header: str = "WARC-Record-ID") -> int | None:
        return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", self.headers.get(header, ""))) else None

    @property
    def url(self) -> str | None:
        u = self.headers.get("WARC-Target-URI")
        return u if u is None else re.sub(r"%([01][0-9A-F]|7F|25(?=[01][0-9A-F]|7F))", lambda m: chr(int(m[1], 16)), u)


def parse(data: bytes) -> Record:
    """A record by its content length, with the digests of its block and, of a response, its payload verified."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    length = int(headers["Content-Length"])
    block = rest[:length]
    if not found or not first.startswith("WARC/") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the record {headers.get('WARC-Record-ID')} isn't framed by its content length")
    if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"the block of {headers.get('WARC-Record-ID')} doesn't have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != full or digest != sha1_base32(payload)):
        raise ValueError(f"the payload of {headers.get('WARC-Record-ID')} doesn't have its digest")
    return Record(kind, headers, block, payload, full, digest)


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records (page_id, url, html, refers_to) into archives under folder; returns archive, n_records: those that were closed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out, name, count, done = None, "", 0, []
        for batch in batches:
            urls, known = as_strings(batch.column(1)), batch.column(1).is_valid().to_pylist()
            for i in range(batch.num_rows):
                page, refers = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                url, html = urls[i] if known[i] else None, as_bytes(batch.column(2).slice(i, 1))[0]
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                out.write(gzip_member(record(page, url, html, refers)))
                count += 1
                if out.tell() >= ROLL:
                    out.close()
                    done.append((f"{folder}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        yield pa.RecordBatch.from_pydict({"archive": pa.array([a for a, _ in done], pa.string()), "n_records": pa.array([n for _, n in done], pa.int64())})

    return scratch(records.select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, n_records bigint"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (archive, n_records), each read once from start to end; a task reads one after another.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and html if payloads are asked for (of
    responses). A digest, length or number of records that is not as written is an error; what revisits say of the
    payload is only checked by verified().
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("html", pa.string())] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                seen, rows, held = 0, [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in map(parse, members(stream)):
                        seen, held = seen + 1, held + len(r.payload) * payloads
                        rows.append((r.page(), r.url, r.payload_length, r.digest, r.kind, r.page("WARC-Refers-To"), r.payload.decode("utf-8", "replace")))
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=False)], names=[n for n, _ in kinds])
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{uri} has {seen} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=False)], names=[n for n, _ in kinds])

    names = {pa.int64(): "bigint", pa.string(): "string"}
    n = archives.count()
    tasks = archives.repartitionByRange(min(n, 16 * archives.sparkSession.sparkContext.defaultParallelism), "archive") if n else archives
    return tasks.mapInArrow(read, ", ".join(f"{c} {names[k]}" for c, k in kinds))


def verified(records: DataFrame) -> DataFrame:
    """records as they are, but a revisit whose page_id, digest and length no response has is an error."""
    names = {"r_page": "page_id", "r_digest": "payload_digest", "r_bytes": "payload_bytes"}
    responses = records.where("record_type = 'response'").select(*(F.col(c).alias(k) for k, c in names.items())).distinct()
    same = (F.col("refers_to") == F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest")) & (F.col("payload_bytes") == F.col("r_bytes"))
    wrong = (F.col("record_type") == "revisit") & F.col("r_page").isNull()
    error = F.raise_error(F.concat(F.lit("the payload of the revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" isn't that of its response"))).cast("string")
    return records.join(responses, same, "left").withColumn("record_type", F.when(wrong, error).otherwise(F.col("record_type"))).select(*records.columns)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of rows with equal payloads of at least least_bytes, the largest page_id, for all others.

    Equal means an equal SHA-256. Digests and ids alone are grouped; what occurs more than once is sent to the pages
    if it is at most MOST_BROADCAST rows, and beyond that the pages are shuffled to it. Rows without a page_id never
    refer and are never referred to; repeated rows of the largest page_id are all responses.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digest = F.when(F.octet_length(payload) >= least_bytes, F.unhex(F.sha2(payload, 256)))
    rows = pages.select("page_id", "url", "html", digest.alias("d"))
    last = rows.groupBy(F.col("d").alias("e")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and e is not null and last is not null").select("e", "last")
    last = scratch(last, "repeated")
    last = F.broadcast(last) if last.count() <= MOST_BROADCAST else last
    return rows.join(last, F.col("d") == F.col("e"), "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per row of pages, by writing them to archives in the shared folder and reading those back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A null html is an empty payload; bytes that aren't UTF-8 stay as they are in a payload and are replaced in a
    url; null page_ids come back null, as responses; a null url stays null; an empty table writes no archive and
    gives no rows. Other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if ":/" in folder else f"file://{folder}"
    records = scratch(read_archives(write_archives(with_revisits(pages, least_bytes), folder)), "records")
    return verified(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

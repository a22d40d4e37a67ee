"""WARC archives: writing pages as records, normalising monolithic gzip, reading back through a sidecar index.

A monolithic archive is one gzip stream over many records, so nothing in it can be reached without inflating all
before it. The normaliser inflates such a stream once, front to back, rewrites every record as a gzip member of its
own, and writes a sidecar index of offsets. Tasks hold one record at a time. Every file gets a fresh name and only names
that a finished task returned are read on, so a task that is run again after a loss leaves no half file in use.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CRLF = b"\r\n"
CHUNK = 1 << 20
MOST_SENT = 200_000  # repeated digests of some 100 bytes that are broadcast
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(uri: str | None) -> int | None:
    """The page id in <urn:page:N>, null for <urn:page:>."""
    tail = (uri or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the headers only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + body + CRLF * 2


def parse(raw: bytes) -> dict:
    """Fields of one record; the digest of a payload that is present is computed from it and must agree."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(CRLF * 2)
    length = next(int(x.partition(b":")[2]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "page_id": _number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def inflate(stream) -> Iterator[bytes]:
    """Chunks of a gzip file of one member or several."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            yield z.decompress(data)
            data = b""
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, from chunks that are cut anywhere."""
    buf = bytearray()
    for chunk in chunks:
        buf += chunk
        at = 0
        while (end := buf.find(CRLF * 2, at)) >= 0:
            head = bytes(buf[at:end]).lower()
            k = head.index(b"\r\ncontent-length:")
            size = int(head[k + 17 :].split(CRLF, 1)[0])
            stop = end + 4 + size + 4
            if stop > len(buf):
                break
            yield bytes(buf[at:stop])
            at = stop
        del buf[:at]
    if buf:
        raise ValueError("archive ends within a record")


def member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_monolithic(pages: DataFrame, folder: str, date: str, roll_bytes: int, level: int) -> DataFrame:
    """Writes rows (page_id, url, html, refers_to) as archives of one gzip stream each; returns (archive, n_records)."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = out = z = None
        size = n = 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": [n]})

        for batch in batches:
            for page_id, url, html, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page_id, url, (html or "").encode(), ref, date)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, n_records long")


def normalise(archives: DataFrame, folder: str, level: int) -> DataFrame:
    """Rewrites each archive as one gzip member a record, with a sidecar index; returns (archive, members, index, n_records).

    Index lines: offset, length, record id, tab separated.
    """

    def rewrite(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                src, at = fs.FileSystem.from_uri(path)
                name, offset, lines = uuid.uuid4().hex, 0, 0
                with src.open_input_stream(at, compression=None) as stream, store.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, store.open_output_stream(f"{root}/{name}.idx", compression=None) as idx:
                    for raw in split_records(inflate(stream)):
                        packed = member(raw, level)
                        k = raw.index(b"WARC-Record-ID: ") + 16
                        out.write(packed)
                        idx.write(b"%d\t%d\t%s\n" % (offset, len(packed), raw[k : raw.index(CRLF, k)]))
                        offset, lines = offset + len(packed), lines + 1
                yield pa.RecordBatch.from_pydict({"archive": [path], "members": [f"{folder}/{name}.warc.gz"], "index": [f"{folder}/{name}.idx"], "n_records": [lines]})

    return archives.select("archive").mapInArrow(rewrite, "archive string, members string, index string, n_records long")


def read_members(indexed: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of normalised archives, each reached by its offset in the sidecar index."""

    def read(batches):
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        for batch in batches:
            for members, index in zip(batch.column("members").to_pylist(), batch.column("index").to_pylist()):
                store, at = fs.FileSystem.from_uri(members)
                _, side = fs.FileSystem.from_uri(index)
                with store.open_input_stream(side, compression=None) as f:
                    entries = f.read().splitlines()
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for line in entries:
                        offset, length, rid = line.split(b"\t")
                        f.seek(int(offset))
                        got = parse(zlib.decompress(f.read(int(length)), 31))
                        if _number(rid.decode()) != got["page_id"]:
                            raise ValueError(f"index of {members} is out of step at {offset}")
                        if not with_payload:
                            got["payload"] = None
                        rows.append(got)
                        held += len(got["payload"] or b"") + 200
                        if held > 4 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return indexed.select("members", "index").mapInArrow(read, READ_SCHEMA)


def mark_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to: of pages with equal payloads the largest page_id is the response (null), others refer to it.

    Payloads under least_bytes are all responses. Rows that repeat the largest page_id with the same payload are all
    responses; a null page_id refers to the largest known one of its payload, if there is one.
    """
    p = pages.withColumn("_n", F.octet_length(F.coalesce("html", F.lit("")))).withColumn("_d", F.sha1(F.coalesce("html", F.lit(""))))
    # only payloads that occur more than once: few rows, minima pre-aggregated
    twice = p.groupBy("_d", "_n").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    twice = scratch.table(twice.where(F.col("_n") >= least_bytes), "repeated")
    # up to 20 MB the repeated digests go to the pages; beyond, payloads are shuffled, and Spark splits a common page's key
    out = p.join(F.broadcast(twice) if twice.count() <= MOST_SENT else twice, ["_d", "_n"], "left")
    return out.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("_last")), None).otherwise(F.col("_last"))).drop("_d", "_n", "_last")


def archive_and_read(pages: DataFrame, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", roll_bytes: int = 32 << 20, level: int = 1, with_payload: bool = True) -> DataFrame:
    """Pages (page_id, url, html) to monolithic archives, normalised, read back: READ_SCHEMA.

    Null html counts as empty, a null url too. Extra columns are ignored; an empty table gives no rows. Archives and
    indexes lie in the shared folder; see Scratch.
    """
    scratch = Scratch(pages.sparkSession)
    marked = mark_revisits(pages.select("page_id", "url", "html"), scratch, least_bytes)
    written = scratch.table(write_monolithic(marked, scratch.path("monolithic"), date, roll_bytes, level), "manifest")
    n = max(1, written.count())
    # an archive is a task's work: the manifest is dealt out by row, not by its bytes
    indexed = scratch.table(normalise(written.repartition(n), scratch.path("members"), level), "indexed")
    return read_members(indexed.repartition(n), with_payload)

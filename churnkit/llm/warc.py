"""WARC archives: a writer that stores equal payloads once, a sequential reader.

One gzip member per record. Of the records with equal payloads the one with
the largest page_id holds the payload (``response``), the others refer to it
(``revisit``). Archives are written by the tasks through ``pyarrow.fs`` below
the shared folder, under a name of the attempt's own; only the names that a
finished attempt returned are read. The reader goes through an archive once:
it inflates member by member in small pieces, follows Content-Length, and
checks block and payload digests without holding a payload in memory.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C

PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTING = "path string, records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, digest_ok boolean")


class DamagedArchive(ValueError):
    """A member, header or length that doesn't follow the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none:' + uuid.uuid4().hex if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: an HTTP response, or its headers alone for a revisit."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, roll: int) -> Iterator[pa.RecordBatch]:
    store, top = pafs.FileSystem.from_uri(folder)
    made: list[tuple[str, int]] = []
    sink, written, records, name = None, 0, 0, ""
    for batch in C.groups(batches, "html"):
        pages = zip(C.column(batch, "page_id").to_pylist(), C.column(batch, "url").to_pylist(), C.utf8(batch, "html"),
                    C.column(batch, "refers_to").to_pylist(), strict=True)
        for page_id, url, payload, refers_to in pages:
            if sink is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                sink, written, records = store.open_output_stream(f"{top}/{name}", compression=None), 0, 0
            gz = zlib.compressobj(6, wbits=31)
            data = gz.compress(record(page_id, url, payload, refers_to, date)) + gz.flush()
            sink.write(data)
            written += len(data)
            records += 1
            if written >= roll:
                sink.close()
                made.append((f"{folder}/{name}", records))
                sink = None
    if sink is not None:
        sink.close()
        made.append((f"{folder}/{name}", records))
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())],
                                         names=["path", "records"])


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
          roll: int = 256 << 20) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) into archives
    below the URI ``folder``; returns the listing (path, records).

    Null html is an empty payload. Payloads of at least ``min_bytes`` bytes
    that equal another one become revisits of the row with the largest
    page_id; rows that share that page_id too are all responses. A null
    page_id is always a response. Further columns are ignored.
    """
    spark = pages.sparkSession
    store, top = pafs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.select("page_id", F.unhex(F.sha2("html", 256)).alias("key"), F.octet_length("html").alias("bytes"))
    keyed = keyed.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    holders = (keyed.groupBy("key", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
               .where("n > 1").drop("n"))
    revisits = (keyed.join(holders, ["key", "bytes"]).where("page_id < refers_to")
                .select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), "refers_to").distinct())
    own = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    told = own.join(revisits, (own["page_id"] == revisits["_id"]) & (own["key"] == revisits["_key"]), "left")
    listing = C.map_arrow(told.select("page_id", "url", "html", "refers_to"),
                          partial(_write, folder=folder.rstrip("/"), date=date, roll=roll), LISTING)
    return C.stage(listing, "warc-listing")


def members(source) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member, one member after the other."""
    data = source.read(PIECE)
    while data:
        rest = [data]

        def pieces() -> Iterator[bytes]:
            inflate = zlib.decompressobj(wbits=31)
            chunk = rest.pop()
            while True:
                try:
                    out = inflate.decompress(chunk, PIECE)
                    while out:
                        yield out
                        out = b"" if inflate.eof else inflate.decompress(inflate.unconsumed_tail, PIECE)
                except zlib.error as e:
                    raise DamagedArchive(str(e)) from e
                if inflate.eof:
                    rest.append(inflate.unused_data)
                    return
                chunk = source.read(PIECE)
                if not chunk:
                    raise DamagedArchive("the archive ends inside a member")

        yield pieces()
        data = rest.pop() or source.read(PIECE)


def _until_blank(buffer: bytearray, pieces: Iterator[bytes]) -> list[str]:
    """Header lines up to the blank line; the buffer keeps what follows."""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise DamagedArchive("a header without an end")
        buffer += piece
    lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
    del buffer[:end + 4]
    return lines


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _id(value: str) -> int | None:
    tail = value.strip("<>").removeprefix("urn:page:")
    return None if tail.startswith("none:") else int(tail)


def read_record(pieces: Iterator[bytes]) -> tuple:
    """The fields of RECORDS from one member; the payload is digested as it streams by."""
    buffer = bytearray()
    lines = _until_blank(buffer, pieces)
    if not lines[0].startswith("WARC/"):
        raise DamagedArchive(f"no WARC record: {lines[0][:40]}")
    head = _fields(lines[1:])
    left = int(head["content-length"])
    block, payload, http, size = hashlib.sha1(), hashlib.sha1(), bytearray(), -1
    length = None
    while left:
        if not buffer:
            piece = next(pieces, None)
            if piece is None:
                raise DamagedArchive("a block shorter than its Content-Length")
            buffer += piece
        part = bytes(buffer[:left])
        del buffer[:len(part)]
        left -= len(part)
        block.update(part)
        if size < 0:                                  # still in the HTTP header
            http += part
            end = http.find(b"\r\n\r\n")
            if end >= 0:
                length = _fields(bytes(http[:end]).decode("latin-1").split("\r\n")[1:]).get("content-length")
                body = bytes(http[end + 4:])
                payload.update(body)
                size = len(body)
        else:
            payload.update(part)
            size += len(part)
    for piece in pieces:
        buffer += piece
    if bytes(buffer) != b"\r\n\r\n":
        raise DamagedArchive("a record without its closing line ends")
    told = lambda name: head.get(name, "").removeprefix("sha1:")
    found = base64.b32encode(payload.digest()).decode()
    ok = told("warc-block-digest") == base64.b32encode(block.digest()).decode()
    revisit = head["warc-type"] == "revisit"
    if not revisit:
        ok = ok and told("warc-payload-digest") == found and (length is None or int(length) == size)
    return (_id(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"],
            _id(head["warc-refers-to"]) if revisit else None, int(length or 0) if revisit else size,
            told("warc-payload-digest") if revisit else found, ok)


def _read(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("digest_ok", pa.bool_())])

    def pack(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema,
                                                                               strict=True)], schema=schema)

    for batch in batches:
        for path in C.column(batch, "path").to_pylist():
            store, at = pafs.FileSystem.from_uri(path)
            found: list[tuple] = []
            with store.open_input_stream(at, compression=None, buffer_size=PIECE) as source:
                for pieces in members(source):
                    found.append(read_record(pieces))
                    if len(found) >= rows:
                        yield pack(found)
                        found = []
            if found:
                yield pack(found)


def read(listing: DataFrame) -> DataFrame:
    """One row per record of the archives in ``listing.path``, each archive read
    once from start to end by one task. ``digest_ok`` tells whether the block
    digest, and for responses the payload digest and length, agree with what
    was read; a damaged frame raises DamagedArchive."""
    n = max(1, listing.count())
    return C.map_arrow(listing.select("path").repartition(n), _read, RECORDS)


def round_trip(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back; records whose digests don't agree raise."""
    found = read(write(pages, folder, min_bytes))
    return found.where(F.when(F.col("digest_ok"), F.lit(True))
                       .otherwise(F.raise_error(F.concat(F.lit("digest mismatch in record "),
                                                         F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
                                  .cast("boolean")))

"""Token ids in binary files: patched frame-of-reference blocks.

``write`` sorts the documents by doc_id into ranges of about equal bytes (Spark
samples the ids and sorts each range), a task encodes its range group by group
and streams it into a file of its own. A file is a row of blocks of ``BLOCK``
ids. A block stores its least id; each id's distance from it is packed in as
many bits as the distances up to a percentile need; the few that need more are
exceptions: their place and what is above the packed bits follow the block. The
file ends with the start of every block and a directory of the documents.
``read`` lets a task per file go through it and unpack some blocks at a time;
``Reader.ids`` finds any range of ids from the block starts alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm import common as C
from churnkit.llm.encoding import ID, encoder

MAGIC = b"IDPFOR1\n"
BLOCK = 1024                          # ids of a block; whole 64-bit words at any width
LANES = 64
HEADER = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("extra", "<u2")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_tokens", "<u8")])
FOOTER = struct.Struct("<QQQ8s")      # blocks, documents, ids, MAGIC
READ_BLOCKS = 512
LISTING = "part long, path string, n_docs long, n_tokens long, n_bytes long"


class DamagedFile(ValueError):
    """A file that doesn't follow the format."""


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits that each number below 2**32 takes."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**width as rows of 64-bit words."""
    lanes = values.reshape(len(values), -1, LANES).astype(np.uint64)
    out = np.zeros((len(values), BLOCK // LANES, max(width, 1)), np.uint64)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, :, word] |= lanes[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)[:, :BLOCK * width // 64]


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The numbers of rows of 64-bit words."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint64)
    words = words.reshape(len(words), BLOCK // LANES, width)
    out = np.empty((len(words), BLOCK // LANES, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(LANES):
        word, shift = divmod(j * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, j] = value & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float) -> tuple[list[bytes], np.ndarray]:
    """The stored form of whole blocks, and their headers (starts left at 0)."""
    rows = ids.reshape(-1, BLOCK)
    least = rows.min(axis=1)
    above = rows - least[:, None]
    at = min(int(percentile * BLOCK), BLOCK - 1)
    width = bit_length(np.partition(above, at, axis=1)[:, at])
    head = np.zeros(len(rows), HEADER)
    head["least"], head["width"] = least, width
    stored: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        values = above[own]
        high = values >> np.uint32(w) if w < 32 else np.zeros_like(values)
        low = values & np.uint32((1 << w) - 1)
        packed = pack(low, w).astype("<u8")
        block, place = np.nonzero(high)
        cuts = np.searchsorted(block, np.arange(len(own) + 1))
        head["extra"][own] = np.diff(cuts)
        place, rest = place.astype("<u2"), high[block, place].astype("<u4")
        for i, k in enumerate(own.tolist()):
            a, b = cuts[i], cuts[i + 1]
            stored[k] = packed[i].tobytes() + place[a:b].tobytes() + rest[a:b].tobytes()
    return stored, head


def decode_blocks(data: bytes, head: np.ndarray) -> np.ndarray:
    """The ids of blocks that stand one after the other in ``data``."""
    out = np.empty((len(head), BLOCK), np.uint32)
    begins = (head["start"] - head["start"][0]).astype(np.int64)
    for w in np.unique(head["width"]).tolist():
        own = np.flatnonzero(head["width"] == w)
        size = BLOCK * w // 8
        words = np.frombuffer(b"".join([data[a:a + size] for a in begins[own].tolist()]), "<u8").reshape(len(own), -1)
        values = unpack(words, w).astype(np.uint32)
        for i, k in enumerate(own.tolist()):
            extra, a = int(head["extra"][k]), int(begins[k]) + size
            if extra:
                place = np.frombuffer(data, "<u2", extra, a)
                values[i, place] |= np.frombuffer(data, "<u4", extra, a + 2 * extra) << np.uint32(w)
        out[own] = values + head["least"][own][:, None]
    return out.reshape(-1)


class Writer:
    """Streams the ids of documents into a file."""

    def __init__(self, sink, percentile: float):
        self.sink, self.percentile = sink, percentile
        self.sink.write(MAGIC)
        self.at, self.n_tokens, self.n_docs = len(MAGIC), 0, 0
        self.rest = np.empty(0, ID)
        self.heads: list[np.ndarray] = []
        self.documents: list[np.ndarray] = []

    def _blocks(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        stored, head = encode_blocks(ids, self.percentile)
        sizes = np.fromiter(map(len, stored), np.int64, len(stored))
        head["start"] = self.at + np.cumsum(sizes) - sizes
        self.sink.write(b"".join(stored))
        self.at += int(sizes.sum())
        self.heads.append(head)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        rows = np.zeros(len(counts), DOCUMENT)
        rows["known"] = ~doc_ids.is_null().to_numpy(zero_copy_only=False)
        rows["doc_id"], rows["n_tokens"] = doc_ids.fill_null(0).to_numpy(), counts
        self.documents.append(rows)
        self.n_docs += len(rows)
        self.n_tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:].copy()

    def close(self) -> int:
        """Write the last block (filled up with its last id) and the directory; returns the file's size."""
        if len(self.rest):
            self._blocks(np.concatenate([self.rest, np.repeat(self.rest[-1:], BLOCK - len(self.rest))]))
        heads = np.concatenate([np.zeros(0, HEADER), *self.heads]).tobytes()
        documents = np.concatenate([np.zeros(0, DOCUMENT), *self.documents]).tobytes()
        footer = FOOTER.pack(len(heads) // HEADER.itemsize, self.n_docs, self.n_tokens, MAGIC)
        for part in (heads, documents, footer):
            self.sink.write(part)
            self.at += len(part)
        return self.at


class Reader:
    """Random access to the ids of a file, and its documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < len(MAGIC) + FOOTER.size or source.read_at(len(MAGIC), 0) != MAGIC:
            raise DamagedFile("not a file of ids")
        blocks, docs, self.n_tokens, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        tail = blocks * HEADER.itemsize + docs * DOCUMENT.itemsize
        self.end = size - FOOTER.size - tail
        if magic != MAGIC or self.end < len(MAGIC) or blocks != -(-self.n_tokens // BLOCK):
            raise DamagedFile("the directory does not fit the file")
        data = source.read_at(tail, self.end)
        self.heads = np.frombuffer(data, HEADER, blocks)
        self.documents = np.frombuffer(data, DOCUMENT, docs, blocks * HEADER.itemsize)
        if int(self.documents["n_tokens"].sum()) != self.n_tokens:
            raise DamagedFile("the documents do not add up to the ids")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids ``start`` to ``stop`` of the file."""
        if start >= stop:
            return np.empty(0, ID)
        a, b = start // BLOCK, -(-stop // BLOCK)
        first = int(self.heads["start"][a])
        last = int(self.heads["start"][b]) if b < len(self.heads) else self.end
        return decode_blocks(self.source.read_at(last - first, first), self.heads[a:b])[start - a * BLOCK:stop - a * BLOCK]


def _write_batches(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int,
                   percentile: float) -> Iterator[pa.RecordBatch]:
    """One file for what this task was dealt, under a name of the attempt's own."""
    coder = encoder(path)
    end = np.array([end_id], ID)
    writer = sink = None
    part = -1
    for batch in C.groups(batches):
        if writer is None:
            store, at = pafs.FileSystem.from_uri(folder)
            store.create_dir(at)
            part = C.column(batch, "part")[0].as_py()
            name = f"part-{part:09d}-{uuid.uuid4().hex}.ids"
            sink = store.open_output_stream(f"{at}/{name}")
            writer = Writer(sink, percentile)
        ids, counts = coder.encode(C.utf8(batch))
        writer.add(C.column(batch, "doc_id"), np.insert(ids, np.cumsum(counts), end), counts + 1)
    if writer is not None:
        size = writer.close()
        sink.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [writer.n_docs],
                                          "n_tokens": [writer.n_tokens], "n_bytes": [size]})


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, percentile: float = 0.98,
          file_bytes: int = 32 << 20) -> DataFrame:
    """Write the ids of ``docs`` below ``folder`` in ascending doc_id order;
    returns the listing (part, path, n_docs, n_tokens, n_bytes), a row per file,
    itself written below the shared folder.

    ``path`` is the vocabulary file, readable on every executor; ``end_id``
    follows each document. Null text is empty, long texts are whole. Rows
    without a doc_id come first; rows that share one (a third of all, say) are
    in the order of their text's hash, so that they may be cut into several
    files; only rows equal in both stay in one. doc_id must be an integer.
    Repeated rows stay. An empty table gives no file. Other columns are not
    read. A task lost and run again writes a new file; only listed files count.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    dealt = (narrow.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
             .select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text"))
    task = partial(_write_batches, path=path, folder=folder, end_id=end_id, percentile=percentile)
    return C.stage(C.map_arrow(dealt, task, LISTING), "id-files")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each listed file, with the crc32 of the ids read."""
    for batch in batches:
        for path, first in zip(C.column(batch, "path").to_pylist(), C.column(batch, "first").to_pylist(), strict=True):
            store, at = pafs.FileSystem.from_uri(path)
            with store.open_input_file(at) as source:
                yield from _documents(Reader(source), first)


def _documents(reader: Reader, first: int) -> Iterator[pa.RecordBatch]:
    counts = reader.documents["n_tokens"].astype(np.int64)
    stops = np.cumsum(counts)
    done = 0
    crc = 0
    sums: list[int] = []
    begin = 0
    for a in range(0, reader.n_tokens, READ_BLOCKS * BLOCK):
        b = min(a + READ_BLOCKS * BLOCK, reader.n_tokens)
        view = memoryview(np.ascontiguousarray(reader.ids(a, b), ID)).cast("B")
        at = a
        while done < len(stops) and stops[done] <= b:               # documents that end here
            sums.append(zlib.crc32(view[(at - a) * 4:(int(stops[done]) - a) * 4], crc))
            at, crc, done = int(stops[done]), 0, done + 1
        if at < b:
            crc = zlib.crc32(view[(at - a) * 4:], crc)
        rows = reader.documents[begin:done]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], mask=rows["known"] == 0), pa.array(first + stops[begin:done] - counts[begin:done]),
             pa.array(counts[begin:done]), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        sums, begin = [], done


def read(listing: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the listed
    files. ``start`` counts the ids of all documents before it. An empty
    listing gives no rows; a file that does not fit the format is an error."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one short row per file
    files = C.stage(listing.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first")), "id-order")
    n = max(1, files.count())
    return C.map_arrow(files.repartition(n, "part"), _read_batches,
                       "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, folder: str, end_id: int = 0, **how) -> DataFrame:
    """Write ``docs`` and return what ``read`` finds in the files."""
    return read(write(docs, path, folder, end_id, **how))

"""Best-fit packing of tokenized documents into sequences of fixed length.

``tokenize`` makes pieces: a document's ids followed by the end id, cut into
``capacity`` pieces only when longer, the odd piece first. Full pieces are
sequences already. ``pack`` deals the others evenly over tasks; each task
packs its items best-fit, longest first, and emits bins that are nearly full.
The rest go up a tree as items of their own (a bin of 700 tokens is an item of
700), ``fan_in`` tasks to one, and are packed again, until one task is left.
What one task sends up is bounded by ``carry`` bins, so that no level gathers
more than ``fan_in * carry`` items; bins beyond it are emitted as they are
(emptiest bins travel, since only those can still take something).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C
from churnkit.llm.encoding import ID, encoder


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in C.groups(batches):
        row, piece, start, length, crc = [], [], [], [], []
        found, counts = coder.encode(C.utf8(batch))
        data = np.insert(found, np.cumsum(counts), np.array([end_id], ID)).tobytes()
        stops = (np.cumsum(counts + 1) * ID.itemsize).tolist()
        for i, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            ids = memoryview(data)[a:b]
            total = len(ids) // ID.itemsize
            first = total % capacity or capacity
            at, n = 0, 0
            while at < total:
                size = first if at == 0 else capacity
                row.append(i)
                piece.append(n)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[at * 4:(at + size) * 4]))
                at, n = at + size, n + 1
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
             *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenize(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every row;
    null and empty texts are one piece, the end id alone."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(narrow, partial(_piece_batches, path=path, capacity=capacity, end_id=end_id),
                       f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest items
    first, each into the fullest open bin that still takes it.

    Open bins stand in stacks by free room; a bit of ``rooms`` tells which
    stacks hold something, so the tightest fit is the lowest set bit from the
    item's length on, found without a scan.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, capacity - room
        fill[b] += size
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return where, offset, np.array(fill, np.int64)


def _leaf(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Pack the pieces of one task: they get their local bin, its fill, and the place in it."""
    rows = [f for f in frames if len(f)]
    if rows:
        items = pd.concat(rows, ignore_index=True)
        part = items.pop("part")
        for p, own in items.groupby(part.to_numpy(), sort=True):
            bins, offset, fill = best_fit(own["length"].to_numpy(), capacity)
            yield own.assign(bin=(np.int64(p) << 32) + bins, offset=offset, fill=fill[bins])


def _node(bins: pd.DataFrame, capacity: int, nearly: int, carry: int, level: int) -> pd.DataFrame:
    """Pack the bins that one node of the tree was sent. A member row (leaf bin,
    its offset) follows its bin; ``open`` bins travel on."""
    items = bins.drop_duplicates("bin")
    where, offset, fill = best_fit(items["fill"].to_numpy(), capacity)
    base = (np.int64(level) << 56) + (np.int64(bins["node"].iloc[0]) << 28)
    place = pd.DataFrame({"bin": items["bin"].to_numpy(), "new": base + where, "at": offset, "total": fill[where]})
    found = bins.merge(place, on="bin")
    out = pd.DataFrame({"leaf": found["leaf"], "shift": found["shift"] + found["at"], "bin": found["new"],
                        "fill": found["total"], "node": found["node"]})
    unfilled = np.flatnonzero(capacity - fill > nearly)
    travel = heapq.nsmallest(carry, unfilled.tolist(), key=lambda b: (fill[b], b))
    return out.assign(open=out["bin"].isin(base + np.array(travel, np.int64)))


def _climber(capacity: int, nearly: int, carry: int, level: int):
    def climb(bins: pd.DataFrame) -> pd.DataFrame:
        return _node(bins, capacity, nearly, carry, level)
    return climb


def pack(pieces: DataFrame, capacity: int = 1024, items: int = 50_000, fan_in: int = 8, nearly: int = 4,
         carry: int = 4096) -> DataFrame:
    """``pieces`` (with length) plus sequence_id and offset, gapless from 0 in each sequence.

    About ``items`` pieces are packed at a leaf. A bin with at most ``nearly``
    free places is emitted at once. Every piece gets exactly one place; a
    length over ``capacity`` or below one is an error.
    """
    spark = pieces.sparkSession
    pieces = C.stage(pieces.withColumn("length", F.when(
        F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("piece length")).cast("long"))),
        "pieces")
    odd = F.col("length") < capacity
    n_odd = pieces.where(odd).count()
    parts = max(1, -(-n_odd // items))
    if n_odd == 0:
        return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    names = pieces.columns
    dealt = pieces.where(odd).withColumn("part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    C.ship_package(spark)
    leaves = C.stage(dealt.repartition(parts, "part").mapInPandas(
        partial(_leaf, capacity=capacity), schema + ", bin long, offset long, fill long"), "leaves")
    # climb: only one row per bin, not per piece
    level = 0
    current = (leaves.where(F.lit(capacity) - F.col("fill") > nearly).select("bin", "fill").distinct()
               .select(F.col("bin").alias("leaf"), F.lit(0).cast("long").alias("shift"), "bin", "fill",
                       F.shiftright("bin", 32).alias("node")))
    placed: list[DataFrame] = []
    while parts > 1 or level == 0:
        level, parts = level + 1, max(1, -(-parts // fan_in))
        last = parts == 1
        up = current.withColumn("node", F.floor(F.col("node") / fan_in))
        packed = C.stage(up.groupBy("node").applyInPandas(
            _climber(capacity, nearly, 0 if last else carry, level),
            "leaf long, shift long, bin long, fill long, node long, open boolean"), "climb")
        placed.append(packed.where("not open").select("leaf", "shift", F.col("bin").alias("top")))
        current = packed.where("open").drop("open")
    moved = placed[0]
    for more in placed[1:]:
        moved = moved.unionByName(more)
    settled = leaves.join(moved, leaves["bin"] == moved["leaf"], "left").select(
        *names, F.coalesce("top", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    whole = pieces.where(~odd).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                                      F.lit(0).cast("long").alias("offset"))
    return settled.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every
    document of ``docs`` tokenized and placed.

    Null and empty texts give one piece of one id. Very long texts are cut,
    never shortened. Repeated rows and rows without a doc_id are packed like
    any other. An empty table gives an empty result; other columns are not read.
    """
    return pack(tokenize(docs, path, capacity, end_id), capacity, **how)
